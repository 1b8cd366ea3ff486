"""DuckDB SQL with the same rows as the catalogue's queries, and the rules that both pin."""

from __future__ import annotations

from plumbline.functions.text import STOPWORDS

#: Rules that occur in the driver's tables.
PHRASES = ("of the", "in the", "de la", "die der", "the the")
REGEXES = (r"[0-9]{3}-[0-9]{4}", r"er[a-z]*tion\.", r"license[ds]?[ .,]")
NGRAMS = (("creative", "commons"), ("public", "license"), ("general", "public", "license"), ("gnu", "general"))
#: Patterns that look around: words in "er...tion" before a blank or comma; a licence after a word of three letters or more.
LOOKAROUND = (r"er(?=[a-z]*tion[ ,])[a-z]+", r"(?<=[a-z]{3} )licen[cs]e(?=[ds]?[ .,])")
#: Words that the repair loop replaces, and what by.
BANNED_WORDS = ("license", "commons", "public", "of")
OPTIONS = ((" stone", -0.5), (" river", -1.5), (" of", -2.0))
PREFIX_RULES = ("t1", "t2 and more", "T33")
#: (temperature, min-p, top-p, top-k) of each rung.
LADDER = [(0.7, 0.8, 0.5, 5), (1.0, 0.8, 0.5, 5), (1.0, None, 0.5, 5), (1.0, None, None, 5), (1.0, None, None, None)]
HUMAN_MIN = 1

_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
_docs = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_words = lambda source, least=4: f"SELECT list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: length(w) >= {least} AND w NOT IN ({_stop})) AS w FROM {source}"


def _grams(source: str, n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT unnest([{gram} FOR i IN range(1, len(w) - {n - 2})]) AS term FROM ({_words(source)})"


def _top(n: int, k: int) -> str:
    return f"SELECT term, count(*) AS gen_count, count(*) / (SELECT sum(length(text))::DOUBLE FROM docs) * 100000.0::DOUBLE AS gen_freq_per_100k FROM ({_grams('docs', n)}) GROUP BY term ORDER BY gen_count DESC, term LIMIT {k}"

def _comparison(n: int, k: int) -> str:
    return f"""{_docs}, spoken AS (SELECT text FROM conversations WHERE role = 'assistant'), gen AS ({_top(n, k)}),
human AS (SELECT term, count(*) AS human_count FROM ({_grams('spoken', n)}) GROUP BY term),
chars AS (SELECT sum(length(text))::DOUBLE AS h FROM spoken),
both_ AS (SELECT term, gen_count, gen_freq_per_100k, human_count, coalesce(human_count, 0) / h * 100000.0::DOUBLE AS human_freq_per_100k FROM gen LEFT JOIN human USING (term), chars),
scored AS (SELECT *, CASE WHEN human_freq_per_100k > 0 THEN gen_freq_per_100k / human_freq_per_100k ELSE 'inf'::DOUBLE END AS freq_ratio_gen_hu FROM both_)"""


_compared = _comparison(2, 1000)
_prompts = """firsts AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE lower(role) = 'user' GROUP BY conv_id),
prompts AS (SELECT conv_id, prompt, row_number() OVER (ORDER BY conv_id) - 1 AS prompt_id FROM firsts WHERE coalesce(prompt, '') <> '')"""
_answers = r"answers AS (SELECT conv_id, regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g') AS output FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g') <> '')"
_log = f"""{_prompts}, existing AS (SELECT prompt_id FROM prompts WHERE prompt_id % 3 = 0),
refused AS (SELECT DISTINCT doc_id AS prompt_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0 OR coalesce(text, '') = ''),
pending AS (SELECT prompt_id, prompt FROM prompts WHERE prompt_id NOT IN (SELECT prompt_id FROM existing) AND prompt_id NOT IN (SELECT prompt_id FROM refused)),
placeholders AS (SELECT prompt_id, coalesce(prompt, '') AS prompt FROM refused LEFT JOIN prompts USING (prompt_id) WHERE prompt_id NOT IN (SELECT prompt_id FROM existing))"""

_edge = r"[^\p{L}\p{N}\p{M}]"
_alt = "|".join(sorted(PHRASES, key=lambda p: (len(p), p)))
_phrase = f"(^|{_edge})({_alt})($|{_edge})"
_fused = "(?ims)" + "|".join(f"({r})" for r in REGEXES)
_which = "CASE " + " ".join(f"WHEN regexp_extract(text, '{_fused}', {k + 1}) <> '' THEN '{r}'" for k, r in enumerate(REGEXES)) + " END"
_token = "[ \\n]*[^ \\n]+|[ \\n]+"
_by_n = {n: ", ".join("'" + " ".join(g) + "'" for g in NGRAMS if len(g) == n) for n in (2, 3)}

_ngrams = f"""lows AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws, string_split_regex(lower(text), '\\p{{L}}+') AS gs FROM docs),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, unnest(range(len(ws))) AS place FROM lows),
laid AS (SELECT *, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY place) - length(w))::INT AS start FROM each),
kept AS (SELECT *, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY place) AS w2, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY place) AS w3 FROM laid WHERE w NOT IN ({_stop})),
ngram_hits AS (SELECT doc_id, place, start, 2 AS n, w || ' ' || w2 AS rule FROM kept WHERE w || ' ' || w2 IN ({_by_n[2]})
  UNION ALL SELECT doc_id, place, start, 3, w || ' ' || w2 || ' ' || w3 FROM kept WHERE w || ' ' || w2 || ' ' || w3 IN ({_by_n[3]})),
ngram_first AS (SELECT doc_id, 'ngram' AS kind, start, length(rule) AS length, rule, rule AS match FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, n DESC, rule) AS r FROM ngram_hits) WHERE r = 1)"""
_phrases = f"""phrase_first AS (SELECT doc_id, 'phrase' AS kind, (length(string_split_regex(lower(text), '{_phrase}')[1]) + length(regexp_extract(lower(text), '{_phrase}', 1)))::INT AS start,
  length(regexp_extract(lower(text), '{_phrase}', 2)) AS length, regexp_extract(lower(text), '{_phrase}', 2) AS rule, regexp_extract(lower(text), '{_phrase}', 2) AS match FROM docs WHERE regexp_matches(lower(text), '{_phrase}'))"""
_regexes = f"""regex_first AS (SELECT doc_id, 'regex' AS kind, length(string_split_regex(text, '{_fused}')[1])::INT AS start, length(regexp_extract(text, '{_fused}', 0)) AS length, {_which} AS rule, regexp_extract(text, '{_fused}', 0) AS match
  FROM docs WHERE regexp_matches(text, '{_fused}'))"""
_columns = "doc_id, kind, start, length::INT AS length, rule, match"
# Every boundary character twice, so that neighbouring hits need not share one.
_doubled = rf"""doubled AS (SELECT doc_id, regexp_replace(lower(text), '({_edge})', '\1\1', 'g') AS t FROM docs),
phrase_parts AS (SELECT doc_id, regexp_extract_all(t, '{_phrase.replace(" ", "  ")}', 0) AS m, regexp_extract_all(t, '{_phrase.replace(" ", "  ")}', 1) AS a, regexp_extract_all(t, '{_phrase.replace(" ", "  ")}', 2) AS p, string_split_regex(t, '{_phrase.replace(" ", "  ")}') AS g FROM doubled),
phrase_each AS (SELECT doc_id, unnest(m) AS m, unnest(a) AS a, unnest(p) AS p, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM phrase_parts),
phrase_laid AS (SELECT doc_id, replace(p, '  ', ' ') AS rule, g, m, a, string_agg(g || m, '') OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM phrase_each),
phrase_all AS (SELECT doc_id, rule, substr(upto, 1, length(upto) - length(m) + length(a)) AS before FROM phrase_laid),
phrase_hits AS (SELECT doc_id, rule, ((length(before) + length(regexp_replace(before, '{_edge}', '', 'g'))) / 2)::INT AS start FROM phrase_all)"""


def _earliest(*kinds: str) -> str:
    union = " UNION ALL ".join(f"SELECT *, {p} AS prio FROM {k}_first" for p, k in enumerate(("phrase", "regex", "ngram")) if k in kinds)
    return f"""WITH {_docs}, {_ngrams}, {_phrases}, {_regexes}, firsts AS ({union}),
placed AS (SELECT f.*, text, (len(regexp_extract_all(substr(text, 1, start + 1), '{_token}')) - 1)::INT AS token FROM firsts f JOIN docs USING (doc_id) WHERE start < length(text)),
earliest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token, prio) AS r FROM placed) WHERE r = 1)"""


_all = _earliest("phrase", "regex", "ngram")
_placed = f"""WITH {_docs}, {_ngrams}, {_doubled},
hits AS (SELECT doc_id, 'phrase' AS kind, 0 AS prio, start, length(rule) AS length, rule, rule AS key FROM phrase_hits
  UNION ALL SELECT doc_id, 'ngram', 2, start, length(rule), rule, rule || ' (stopwords_removed=True)' FROM ngram_hits),
placed AS (SELECT h.*, (len(regexp_extract_all(substr(text, 1, start + 1), '{_token}')) - 1)::INT AS token FROM hits h JOIN docs USING (doc_id)),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token, prio, start, length DESC, rule) AS r FROM placed) WHERE r = 1),
suppressed AS (SELECT doc_id, kind, token, key FROM first_ WHERE doc_id % 2 = 0)"""

_positions = """raw AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10.0 AS x, unnest(range(len(embedding))) AS i FROM embeddings),
positions AS (SELECT vec_id, CASE WHEN i % 5 = 0 THEN '*t' ELSE 't' END || i AS token, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS logp FROM raw),
banned AS (SELECT vec_id, token AS banned FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logp DESC, token) AS r FROM positions) WHERE r = 1)"""


def _soft(temperature: float, name: str = "soft") -> str:
    return f"{name} AS (SELECT vec_id, token, pow(exp(logp), 1.0 / {temperature}) / sum(pow(exp(logp), 1.0 / {temperature})) OVER (PARTITION BY vec_id) AS p FROM positions)"


_left = "left_ AS (SELECT vec_id, token, p FROM soft JOIN banned USING (vec_id) WHERE token <> banned)"
_rungs = " UNION ALL ".join(f"SELECT {n} AS n, {t}::DOUBLE AS temp, {s or 'NULL'}::DOUBLE AS share, {p or 'NULL'}::DOUBLE AS cum, {k or 'NULL'}::INT AS k" for n, (t, s, p, k) in enumerate(LADDER))
_kept = f"""rungs AS ({_rungs}),
heated AS (SELECT n, share, cum, k, vec_id, token, pow(exp(logp), 1.0 / temp) / sum(pow(exp(logp), 1.0 / temp)) OVER (PARTITION BY vec_id, n) AS p FROM positions, rungs),
open_ AS (SELECT h.* FROM heated h JOIN banned USING (vec_id) WHERE token <> banned),
shared AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY vec_id, n) AS best FROM open_) WHERE share IS NULL OR p >= share * best),
summed AS (SELECT * FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id, n ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shared) WHERE cum IS NULL OR before < cum),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, n ORDER BY p DESC, token) AS r FROM summed) WHERE k IS NULL OR r <= k)"""
_prefixes = "prefixes AS (SELECT DISTINCT unnest([substr(r, 1, n), ' ' || substr(r, 1, n)]) AS prefix FROM (SELECT r, unnest(range(2, least(15, length(r)) + 1)) AS n FROM (SELECT unnest([" + ", ".join(f"'{r.lower()}'" for r in PREFIX_RULES) + "]) AS r)))"


def _tails(more: str = "") -> str:
    return f"""{_soft(1.0)}, {_left},
top_ AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM (SELECT *, max(p) OVER (PARTITION BY vec_id) AS best FROM left_) WHERE p >= 0.01::DOUBLE * best),
ends AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p, token DESC) AS e FROM top_ WHERE r <= 50 AND NOT contains(token, '*') {more}),
tails AS (SELECT vec_id, string_agg(token, ' ' ORDER BY e) FILTER (WHERE e <= 20) AS tail FROM ends GROUP BY vec_id)"""


_pair_columns = "prompt_raw, generation_raw, context_with_chat_template, chosen_decoded, rejected_decoded, multi_chosen, class, subtype"
# All text before the token is the generation; vectors are dealt to all documents.
_pairs = f"""{_all}, {_positions}, {_tails()}, best AS (SELECT vec_id, token AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM left_) WHERE r = 1),
places AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS vectors FROM embeddings),
split_ AS (SELECT *, regexp_extract_all(text, '{_token}') AS tokens FROM earliest),
pairs AS (SELECT doc_id, doc_id::VARCHAR AS prompt_raw, array_to_string(tokens[1:token], '') AS generation_raw, doc_id::VARCHAR || array_to_string(tokens[1:token], '') AS context_with_chat_template, chosen AS chosen_decoded,
  tokens[token + 1] AS rejected_decoded, tail AS multi_chosen, kind AS class, CASE WHEN kind = 'ngram' THEN CASE WHEN len(string_split(rule, ' ')) = 3 THEN 'trigram' ELSE 'bigram' END ELSE kind END AS subtype
  FROM split_ JOIN places ON place = doc_id % vectors JOIN tails USING (vec_id) JOIN best USING (vec_id))"""
_banned = rf"(^|{_edge})({'|'.join(BANNED_WORDS)})($|{_edge})"
_recited = lambda source, column, most="": f"cut AS (SELECT *, regexp_extract_all({column}, '{_token}'){most} AS ts FROM {source}), recited AS (SELECT *, list_transform(ts, lambda t: CASE WHEN regexp_matches(lower(t), '{_banned}') THEN ' stone' ELSE t END) AS new, len(list_filter(ts, lambda t: regexp_matches(lower(t), '{_banned}'))) AS n FROM cut)"
PROMPTS_SQL, TOKEN_SQL, BANNED_SQL = _prompts, _token, _banned
_run = f"""{_log}, asked AS (SELECT prompt_id, 'Go on: ' || prompt AS prompt FROM pending), {_recited("asked", "prompt", "[1:1200]")}"""
_events = "ev AS (SELECT *, epoch_us(ts) AS us, (event_id % 7 + 1)::BIGINT AS tokens FROM events)"

ORACLES = {
    "unigram_topk": f"WITH {_docs} {_top(1, 2000)}",
    "bigram_topk": f"WITH {_docs} {_top(2, 1000)}",
    "trigram_topk": f"WITH {_docs} {_top(3, 1000)}",
    "ngram_vs_human_matched": f"WITH {_compared} SELECT * FROM scored WHERE human_count IS NOT NULL",
    "ngram_vs_human_gen_only": f"WITH {_compared} SELECT term, gen_count, gen_freq_per_100k, 0::BIGINT AS human_count, 0.0::DOUBLE AS human_freq_per_100k, 'inf'::DOUBLE AS freq_ratio_gen_hu FROM scored WHERE human_count IS NULL",
    "human_ngram_normalize": """WITH raw AS (SELECT item_id % 3 + 1 AS frequency, string_split(text, ' ') AS w FROM benchmark),
items AS (SELECT frequency, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS ngram FROM raw),
normal AS (SELECT frequency, regexp_extract_all(lower(ngram), '\\p{L}+') AS ws FROM items)
SELECT ws[1] || ' ' || ws[2] AS term, sum(frequency)::BIGINT AS count FROM normal WHERE len(ws) = 2 GROUP BY 1""",
    "vocabulary_diversity": f"WITH {_docs}, c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM docs) GROUP BY w) SELECT sum(n)::BIGINT AS words, count(*) AS types, count(*) FILTER (WHERE n = 1) AS once, count(*)::DOUBLE / sum(n)::DOUBLE AS type_token_ratio FROM c",
    "ban_refinement": f"WITH {_comparison(1, 2000)}, known AS (SELECT term FROM gen ORDER BY gen_count DESC, term LIMIT 10) SELECT term, gen_count, freq_ratio_gen_hu FROM scored WHERE human_count >= {HUMAN_MIN} AND freq_ratio_gen_hu >= 1.0 AND term NOT IN (SELECT term FROM known) ORDER BY freq_ratio_gen_hu DESC, gen_count DESC, term LIMIT 50",
    "first_user_prompt": f"WITH {_prompts} SELECT conv_id, prompt FROM prompts",
    "first_assistant_turn": f"WITH {_answers} SELECT conv_id, output FROM answers",
    "text_prompt_filter": f"WITH {_docs} SELECT doc_id FROM docs WHERE NOT (contains(lower(text), 'assistant:') OR contains(lower(text), 'bot:') OR contains(lower(text), 'gpt:') OR contains(text, chr(10) || chr(10)))",
    "render_prompt": f"WITH {_prompts} SELECT conv_id, 'Writing prompt: ' || prompt || chr(10) || chr(10) || 'Your response:' || chr(10) AS rendered FROM prompts",
    "render_chat": f"WITH {_prompts}, {_answers} SELECT conv_id, '<|system|>' || chr(10) || 'Be brief.' || chr(10) || '<|user|>' || chr(10) || prompt || chr(10) || '<|assistant|>' || chr(10) || coalesce(output, '') AS rendered FROM prompts LEFT JOIN answers USING (conv_id)",
    "classifier_input": f"""WITH {_prompts}, {_answers}, cut AS (SELECT conv_id, string_split(prompt, ' ')[1:100] AS u, string_split(output, ' ') AS a FROM prompts JOIN answers USING (conv_id)),
room AS (SELECT conv_id, a, u[1:greatest(40, least(len(u), 256 - len(a)))] AS u FROM cut)
SELECT conv_id, '<|user|>' || chr(10) || array_to_string(u, ' ') || chr(10) || '<|assistant|>' || chr(10) || array_to_string(a[1:256 - len(u)], ' ') AS input FROM room""",
    "number_prompts": f"WITH {_prompts} SELECT conv_id, prompt, prompt_id::BIGINT AS prompt_id FROM prompts",
    "resume_pending": f"WITH {_log} SELECT prompt_id::BIGINT AS prompt_id, prompt FROM pending",
    "resume_pending_limited": f"WITH {_log} SELECT prompt_id::BIGINT AS prompt_id, prompt FROM pending ORDER BY prompt_id LIMIT 10",
    "refusal_ids": f"WITH {_log} SELECT prompt_id::VARCHAR AS prompt_id FROM refused",
    "refusal_placeholders": f"WITH {_log} SELECT prompt_id::BIGINT AS prompt_id, prompt, NULL::VARCHAR AS generation, 'skipped' AS status, 'skipped -- prior refusal' AS error, 0.0::DOUBLE AS duration_sec, 0::BIGINT AS tokens_generated_prompt, true AS refusal_detected FROM placeholders",
    "run_log_union": f"WITH {_log} SELECT prompt_id::BIGINT AS prompt_id, prompt, '> ' || prompt AS generation, 'success' AS status, NULL::VARCHAR AS error, 1.5::DOUBLE AS duration_sec, NULL::BOOLEAN AS refusal_detected FROM prompts WHERE prompt_id % 3 = 0 UNION ALL SELECT prompt_id, prompt, NULL, 'skipped', 'skipped -- prior refusal', 0.0, true FROM placeholders",
    "refusal_decision": f"WITH {_docs}, d AS (SELECT doc_id, trim(text) <> '' AND toxic = 1 AND 0.7::DOUBLE + 0.2::DOUBLE * quality >= 0.8::DOUBLE AS hit FROM labels JOIN docs USING (doc_id)) SELECT doc_id, CASE WHEN hit THEN 'failed' ELSE 'success' END AS status, CASE WHEN hit THEN 'refusal detected' END AS error, hit AS refusal_detected, NOT hit AS keep_pairs FROM d",
    "phrase_first_hit": f"WITH {_docs}, {_phrases} SELECT {_columns} FROM phrase_first",
    "phrase_all_hits": f"WITH {_docs}, {_doubled} SELECT doc_id, start, rule FROM phrase_hits",
    "regex_first_hit": f"WITH {_docs}, {_regexes} SELECT {_columns} FROM regex_first",
    "ngram_first_hit": f"WITH {_docs}, {_ngrams} SELECT {_columns} FROM ngram_first",
    "ngram_hit_counts": f"WITH {_docs}, {_ngrams} SELECT rule AS ngram, count(*) AS hits FROM ngram_hits GROUP BY rule",
    "earliest_violation": f"{_all} SELECT doc_id, token, kind, start, rule, match FROM earliest",
    "earliest_skip_regex": f"{_earliest('phrase', 'ngram')} SELECT doc_id, token, kind, start, rule, match FROM earliest",
    "violation_snippet": f"{_all}, s AS (SELECT *, CASE WHEN kind = 'ngram' THEN 30 ELSE 20 END AS w FROM earliest) SELECT doc_id, kind, replace(substr(text, greatest(start - w, 0) + 1, (start + length + w - greatest(start - w, 0))::BIGINT), chr(10), ' ') AS context FROM s",
    "ban_event_message": f"{_all} SELECT doc_id, CASE kind WHEN 'phrase' THEN 'banned phrase ''' || rule || '''' WHEN 'regex' THEN 'banned pattern /' || rule || '/ at ''' || match || '''' ELSE 'banned n-gram ''' || rule || '''' END AS message FROM earliest",
    "unsuppressed_violation": f"""{_placed}, left_ AS (SELECT p.* FROM placed p ANTI JOIN suppressed s ON p.doc_id = s.doc_id AND p.kind = s.kind AND p.token = s.token AND p.key = s.key)
SELECT doc_id, token, kind, start, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token, prio, start, length DESC, rule) AS r FROM left_) WHERE r = 1""",
    "masked_violation": f"""{_placed}, per_kind AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY token, start, length, rule) AS q FROM placed) WHERE q = 1),
left_ AS (SELECT p.* FROM per_kind p ANTI JOIN suppressed s ON p.doc_id = s.doc_id AND p.kind = s.kind AND p.token = s.token AND p.key = s.key)
SELECT doc_id, token, kind, start, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token, prio, start) AS r FROM left_) WHERE r = 1""",
    "token_offsets": f"WITH {_docs}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_token}')) AS token, unnest(range(len(regexp_extract_all(text, '{_token}')))) AS pos FROM docs), o AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM t) SELECT doc_id, count(*) AS tokens, max(e)::BIGINT AS chars, sum(e - length(token))::BIGINT AS starts FROM o GROUP BY doc_id",
    "offset_to_token": f"WITH {_docs}, o AS (SELECT DISTINCT doc_id, unnest([0, length(text) // 2, length(text)])::INT AS \"offset\" FROM docs) SELECT doc_id, \"offset\", CASE WHEN \"offset\" < length(text) THEN (len(regexp_extract_all(substr(text, 1, \"offset\" + 1), '{_token}')) - 1)::INT END AS pos FROM o JOIN docs USING (doc_id)",
    "softmax_temperature": f"WITH {_positions}, {_soft(0.7)} SELECT vec_id, token, round(p, 6) AS p FROM soft",
    "min_p": f"WITH {_positions}, {_soft(0.7)}, {_left} SELECT vec_id, token, round(p, 6) AS p FROM (SELECT *, max(p) OVER (PARTITION BY vec_id) AS best FROM left_) WHERE p >= 0.3::DOUBLE * best",
    "top_p": f"WITH {_positions}, {_soft(0.7)}, {_left} SELECT vec_id, token, round(p, 6) AS p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM left_) WHERE before < 0.3::DOUBLE",
    "top_k": f"WITH {_positions}, {_soft(0.7)}, {_left} SELECT vec_id, token, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM left_) WHERE r <= 5",
    "relax_ladder": f"""WITH {_positions}, {_kept},
tried AS (SELECT vec_id, token FROM kept WHERE n = 0 AND vec_id % 2 = 0 AND vec_id % 4 <> 0
  UNION ALL SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logp DESC, token) AS r FROM positions) WHERE r <= 63 AND vec_id % 4 = 0),
untried AS (SELECT k.* FROM kept k ANTI JOIN tried t ON k.vec_id = t.vec_id AND k.token = t.token),
first_ AS (SELECT vec_id, min(n) AS rung FROM untried GROUP BY vec_id)
SELECT e.vec_id, rung::INT AS rung, CASE WHEN rung IS NULL THEN -1 ELSE count(token) END::INT AS kept, arg_min(token, r) AS best FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN first_ f USING (vec_id) LEFT JOIN untried u ON u.vec_id = f.vec_id AND u.n = f.rung GROUP BY e.vec_id, rung""",
    "invert_probs": f"WITH {_positions}, {_kept}, one AS (SELECT vec_id, token, max(p) OVER (PARTITION BY vec_id) - p + min(p) OVER (PARTITION BY vec_id) AS q FROM kept WHERE n = 1) SELECT vec_id, token, round(q / sum(q) OVER (PARTITION BY vec_id), 6) AS p FROM one",
    "tail_candidates": f"WITH {_positions}, {_tails()} SELECT vec_id, coalesce(tail, '') AS tail FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN tails USING (vec_id)",
    "banned_prefixes": "SELECT DISTINCT unnest([substr(r, 1, n), ' ' || substr(r, 1, n)]) AS prefix FROM (SELECT r, unnest(range(2, least(15, length(r)) + 1)) AS n FROM (SELECT lower(ltrim(text)) AS r FROM benchmark) WHERE length(r) >= 2)",
    "first_token_prefixes": f"WITH v AS (SELECT unnest([ltrim(text), ' ' || ltrim(text)]) AS v FROM benchmark) SELECT DISTINCT lower(regexp_extract(v, '^(?:{_token})', 0)) AS prefix FROM v WHERE regexp_extract(v, '^(?:{_token})', 0) <> ''",
    "select_tail": """WITH raw AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10.0 / 0.9::DOUBLE AS x, 't' || unnest(range(len(embedding))) AS token FROM embeddings),
soft AS (SELECT vec_id, token, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM raw),
plausible AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY vec_id) AS best FROM soft) WHERE p >= 0.05::DOUBLE * best),
top_ AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM plausible),
ends AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC) AS e FROM top_ WHERE r <= 30)
SELECT vec_id, string_agg(token, ' ' ORDER BY e) FILTER (WHERE e <= 10) AS tail FROM ends GROUP BY vec_id""",
    "weighted_choice": f"WITH {_positions}, {_kept}, drawn AS (SELECT vec_id, token, -ln((('0x' || substr(md5('1:' || vec_id || ':' || token), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / p AS t FROM kept WHERE n = 1) SELECT vec_id, arg_min(token, t) AS chosen FROM drawn GROUP BY vec_id",
    "token_pairs": f"""{_all}, {_positions}, {_tails()}, best AS (SELECT vec_id, token AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM left_) WHERE r = 1),
places AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS vectors FROM embeddings)
SELECT doc_id, e.token AS pos, kind, rule, regexp_extract_all(text, '{_token}')[e.token + 1] AS rejected, chosen, tail FROM earliest e JOIN places ON place = (doc_id * 7 + e.token) % vectors JOIN tails USING (vec_id) JOIN best USING (vec_id)""",
    "token_counts": f"WITH {_docs} SELECT doc_id, len(regexp_extract_all(text, '{_token}'))::INT AS tokens FROM docs",
    "truncated_tokens": f"{_all} SELECT doc_id, token, sha256(array_to_string(regexp_extract_all(text, '{_token}')[1:token], '')) AS kept_sha256 FROM earliest",
    "joined_parts": "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn NULLS LAST, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id",
    "decode_tokens": f"WITH {_docs} SELECT doc_id, sha256(text) AS text_sha256 FROM docs",
    "regex_lookahead_hit": f"""WITH {_docs}, both_ AS (
  SELECT doc_id, 0 AS k, length(string_split_regex(text, '(?i)er[a-z]*tion[ ,]')[1])::INT AS start, regexp_extract(text, '(?i)(er[a-z]*tion)[ ,]', 1) AS match FROM docs WHERE regexp_matches(text, '(?i)er[a-z]*tion[ ,]')
  UNION ALL SELECT doc_id, 1, (length(string_split_regex(text, '(?i)[a-z]{{3}} licen[cs]e[ds]?[ .,]')[1]) + 4)::INT, regexp_extract(text, '(?i)[a-z]{{3}} (licen[cs]e)[ds]?[ .,]', 1) FROM docs WHERE regexp_matches(text, '(?i)[a-z]{{3}} licen[cs]e[ds]?[ .,]'))
SELECT doc_id, 'regex' AS kind, start, length(match)::INT AS length, CASE k WHEN 0 THEN '{LOOKAROUND[0]}' ELSE '{LOOKAROUND[1]}' END AS rule, match FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, k) AS r FROM both_) WHERE r = 1""",
    "fixpoint_backtrack": f"WITH {_docs}, {_recited('docs', 'text')} SELECT doc_id, len(new)::INT AS tokens, n::INT AS events, true AS settled, sha256(array_to_string(new, '')) AS text_sha256 FROM recited",
    "run_log": f"""WITH {_run} SELECT prompt_id::VARCHAR AS prompt_id, prompt, array_to_string(new, '') AS generation, CASE WHEN length(prompt) % 5 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN length(prompt) % 5 = 0 THEN 'refusal detected (Refusal, p=0.900)' END AS error, n::INT AS events, len(new)::BIGINT AS tokens_generated_prompt, length(prompt) % 5 = 0 AS refusal_detected, CASE WHEN length(prompt) % 5 = 0 THEN 0 ELSE n END::INT AS pairs, true AS settled FROM recited
UNION ALL SELECT prompt_id::VARCHAR, CASE WHEN p.prompt = '' THEN '' ELSE 'Go on: ' || p.prompt END, NULL, 'skipped', 'skipped -- prior refusal', 0, 0, true, NULL, NULL FROM placeholders p""",
    "run_pairs": f"""WITH {_run}, places AS (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM recited WHERE length(prompt) % 5 <> 0)
SELECT prompt AS prompt_raw, array_to_string(new[1:i - 1], '') AS generation_raw, prompt || array_to_string(new[1:i - 1], '') AS context_with_chat_template, ' stone' AS chosen_decoded, ts[i] AS rejected_decoded, ' river| stone' AS multi_chosen FROM places WHERE new[i] <> ts[i]""",
    "tail_without_prefixes": f"WITH {_prefixes}, {_positions}, {_tails('AND token NOT IN (SELECT prefix FROM prefixes)')} SELECT vec_id, coalesce(tail, '') AS tail FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN tails USING (vec_id)",
    "preference_pairs": f"{_pairs} SELECT {_pair_columns} FROM pairs",
    "pair_dedup": f"{_pairs} SELECT {_pair_columns} FROM (SELECT *, row_number() OVER (PARTITION BY context_with_chat_template ORDER BY doc_id DESC) AS r FROM pairs) WHERE r = 1",
    "rate_5s_burst": f"""WITH {_events}, per AS (SELECT user_id, us // 12000 AS us, sum(tokens)::BIGINT AS tokens FROM ev GROUP BY 1, 2),
opened AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 5000 THEN 0 ELSE 1 END AS o FROM per),
islands AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS island FROM opened),
merged AS (SELECT user_id, max(us) AS us, sum(tokens)::BIGINT AS tokens FROM islands GROUP BY user_id, island),
framed AS (SELECT *, (us - min(us) OVER w) / 1e6::DOUBLE AS span, sum(tokens) OVER w AS total, count(*) OVER w AS entries, (us - min(us) OVER f) / 1e6::DOUBLE AS last_span, sum(tokens) OVER f AS last_total FROM merged
  WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN 159 PRECEDING AND CURRENT ROW)),
chosen AS (SELECT user_id, us, tokens, CASE WHEN entries > 160 THEN last_span ELSE span END AS span, CASE WHEN entries > 160 THEN last_total ELSE total END AS total FROM framed)
SELECT user_id, us, tokens, round(CASE WHEN span > 1e-6 THEN total / span END, 9) AS rate FROM chosen""",
    "chunk_throughput": "SELECT user_id AS run_id, event_id AS chunk, CASE WHEN event_id % 5 > 0 THEN (event_id * 3 - coalesce(lag(event_id * 3) OVER (PARTITION BY user_id ORDER BY event_id), 0)) / (event_id % 5 / 2.0::DOUBLE) END AS tokens_per_sec FROM events",
    "run_totals": f"WITH {_events}, t AS (SELECT user_id, count(*) AS prompts, sum(tokens)::BIGINT AS tokens, (max(us) - min(us)) / 1e6::DOUBLE AS seconds FROM ev GROUP BY user_id) SELECT *, round(CASE WHEN seconds > 0 THEN tokens / seconds ELSE 0.0 END, 9) AS tokens_per_sec FROM t",
    "profile_zones": "SELECT event_type AS label, round(sum(value), 4) AS seconds, count(*) AS calls, round(sum(value) / count(*) * 1000.0, 4) AS ms_per_call FROM events GROUP BY event_type",
    "stream_rate_watermarked": "WITH e AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, sum(event_id % 7 + 1)::BIGINT AS tokens FROM events GROUP BY 1, 2) SELECT event_type, start, start + INTERVAL 1 HOUR AS \"end\", tokens, tokens / 3600.0::DOUBLE AS rate FROM e",
}
