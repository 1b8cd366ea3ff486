"""The engine's queries: what each operator does to the driver's tables. ``oracles`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config, generate
from plumbline.functions import text as tx
from plumbline.operators import batch, candidates as cd, decode, match, metrics, pairs, profile, repair, resolve
from plumbline.plans import oracles, sourced, standins
from plumbline.plans.oracles import BANNED_WORDS, HUMAN_MIN, LADDER, LOOKAROUND, NGRAMS, OPTIONS, PHRASES, PREFIX_RULES, REGEXES
from plumbline.sources.tables import table

RULES = match.Rules(PHRASES, REGEXES, NGRAMS)


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations")


def spoken(s: SparkSession, d: str) -> DataFrame:
    return turns(s, d).where("role = 'assistant'").select("text")


# Frequency analysis


def top(n: int, k: int):
    return lambda s, d: profile.top_terms(docs(s, d), n, k)


def compared(s: SparkSession, d: str, n: int = 2, k: int = 1000) -> DataFrame:
    human = spoken(s, d)
    return profile.compared(profile.top_terms(docs(s, d), n, k), profile.term_counts(human, n), profile.total_chars(human))


def human_ngram_normalize(s: SparkSession, d: str) -> DataFrame:
    raw = F.split("text", " ")
    pairs_ = F.transform(F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(raw, i + 1)))
    items = table(s, d, "benchmark").select((F.col("item_id") % 3 + 1).alias("frequency"), F.explode(pairs_).alias("ngram"))
    return profile.normalized_profile(items, 2)


def ban_refinement(s: SparkSession, d: str) -> DataFrame:
    known = profile.top_terms(docs(s, d), 1, 10).select("term")
    return profile.refined(compared(s, d, 1, 2000).where(F.col("human_count") >= HUMAN_MIN), known, 50, 1.0)


# Prompts and bookkeeping


def first_user_prompt(s: SparkSession, d: str) -> DataFrame:
    return batch.first_human(turns(s, d))


def prompts(s: SparkSession, d: str) -> DataFrame:
    return batch.numbered(first_user_prompt(s, d), "conv_id")


def existing(s: SparkSession, d: str) -> DataFrame:
    return prompts(s, d).where("prompt_id % 3 = 0").select(F.col("prompt_id").cast("string"))


def refused(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("prompt_id"), (F.col("toxic") == 1).alias("detected"), F.when(F.col("quality") == 0, "failed").otherwise("success").alias("status"), "text")
    return rows.where(batch.is_refused(F.col("detected"), F.col("status"), F.col("text"))).select("prompt_id").distinct()


def placeholders(s: SparkSession, d: str) -> DataFrame:
    return batch.placeholders(refused(s, d), existing(s, d), prompts(s, d))


def run_log_union(s: SparkSession, d: str) -> DataFrame:
    done = prompts(s, d).where("prompt_id % 3 = 0").select("prompt_id", "prompt", F.concat(F.lit("> "), "prompt").alias("generation"), F.lit("success").alias("status"), F.lit(1.5).alias("duration_sec"))
    return batch.run_log(done, placeholders(s, d)).select("prompt_id", "prompt", "generation", "status", "error", "duration_sec", "refusal_detected")


def refusal_decision(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(docs(s, d), "doc_id").select("doc_id", F.col("text").alias("generation"), F.lit("success").alias("status"), F.when(F.col("toxic") == 1, " Refusal ").otherwise("Not refusal").alias("label"), (0.7 + 0.2 * F.col("quality")).alias("confidence"))
    return batch.decided(rows).select("doc_id", "status", "error", "refusal_detected", "keep_pairs")


def render_prompt(s: SparkSession, d: str) -> DataFrame:
    return first_user_prompt(s, d).select("conv_id", batch.templated(F.col("prompt"), "Writing prompt: {prompt}\n\nYour response:\n").alias("rendered"))


def render_chat(s: SparkSession, d: str) -> DataFrame:
    both = first_user_prompt(s, d).join(batch.first_assistant(turns(s, d)), "conv_id", "left")
    return both.select("conv_id", batch.chat(F.col("prompt"), F.coalesce("output", F.lit("")), "Be brief.").alias("rendered"))


def classifier_input(s: SparkSession, d: str) -> DataFrame:
    both = first_user_prompt(s, d).join(batch.first_assistant(turns(s, d)), "conv_id")
    return both.select("conv_id", batch.classifier_input(F.col("prompt"), F.col("output")).alias("input"))


def joined_parts(s: SparkSession, d: str) -> DataFrame:
    return batch.joined(turns(s, d), "conv_id", "turn", "text")


# Rules


def hit_columns(df: DataFrame, hit: str = "hit", *more: str) -> DataFrame:
    return df.select("doc_id", *more, *[F.col(f"{hit}.{c}").alias(c) for c in ("kind", "start", "length", "rule", "match")])


def one_kind(expression):
    return lambda s, d: hit_columns(docs(s, d).select("doc_id", tx.only(expression(F.col("text"), RULES)).alias("hit")))


def phrase_all_hits(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.explode(match.phrase_all(F.col("text"), RULES)).alias("hit")).select("doc_id", "hit.start", "hit.rule")


def ngram_hit_counts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(match.ngram_hits(F.col("text"), RULES)).alias("h")).groupBy(F.col("h.key").alias("ngram")).agg(F.count("*").alias("hits"))


def earliest(skip: tuple[str, ...] = ()):
    def run(s: SparkSession, d: str) -> DataFrame:
        first = match.first_hits(docs(s, d), RULES).select("doc_id", "text", tx.only(resolve.earliest_of(skip)).alias("v"))
        return first.select("doc_id", "v.token", F.col("v.hit.kind").alias("kind"), F.col("v.hit.start").alias("start"), F.col("v.hit.rule").alias("rule"), F.col("v.hit.match").alias("match"), "text", F.col("v.hit").alias("hit"))

    return run


def earliest_violation(s: SparkSession, d: str) -> DataFrame:
    return earliest()(s, d).drop("text", "hit")


def violation_snippet(s: SparkSession, d: str) -> DataFrame:
    e = earliest()(s, d)
    return e.select("doc_id", "kind", F.when(F.col("kind") == "ngram", tx.snippet(F.col("text"), F.col("start"), F.col("hit.length"), 30)).otherwise(tx.snippet(F.col("text"), F.col("start"), F.col("hit.length"), 20)).alias("context"))


def ban_event_message(s: SparkSession, d: str) -> DataFrame:
    return earliest()(s, d).select("doc_id", resolve.message(F.col("hit")).alias("message"))


def placed_hits(s: SparkSession, d: str) -> DataFrame:
    """All hits of each document, in a row, and as suppressed the first of every second document."""
    t = F.col("text")
    hits = F.concat(match.phrase_all(t, RULES), F.transform(match.ngram_hits(t, RULES), lambda h: match.ngram_of(t, h, RULES)).cast(f"array<{match.HIT}>"))
    rows = docs(s, d).select("doc_id", resolve.placed(hits, t).alias("found"))
    first = F.get("found", F.lit(0))
    key = F.struct(first["hit"]["kind"].alias("kind"), first["token"].alias("token"), first["hit"]["detail_key"].alias("detail_key"))
    return rows.withColumn("suppressed", F.when(F.col("doc_id") % 2 == 0, F.array(key)))


def left_of(choice) -> DataFrame:
    def run(s: SparkSession, d: str) -> DataFrame:
        left = placed_hits(s, d).select("doc_id", tx.only(choice(F.col("found"), F.col("suppressed"))).alias("v"))
        return left.select("doc_id", "v.token", F.col("v.hit.kind").alias("kind"), F.col("v.hit.start").alias("start"), F.col("v.hit.rule").alias("rule"))

    return run


def regex_lookahead_hit(s: SparkSession, d: str) -> DataFrame:
    """Patterns with look-ahead and look-behind, which not every engine has."""
    return hit_columns(docs(s, d).select("doc_id", tx.only(match.regex_first(F.col("text"), match.Rules(regexes=LOOKAROUND))).alias("hit")))


# Tokens


def tokens_of(text: str = "text"):
    return F.regexp_extract_all(text, F.lit(tx.TOKEN), F.lit(0))


def token_offsets(s: SparkSession, d: str) -> DataFrame:
    begun = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("chars"), F.lit(0).cast("long").alias("starts"))
    step = lambda a, t: F.struct((a["tokens"] + 1).alias("tokens"), (a["chars"] + F.length(t)).alias("chars"), (a["starts"] + a["chars"]).alias("starts"))
    found = docs(s, d).select("doc_id", F.aggregate(tokens_of(), begun, step).alias("x")).where("x.tokens > 0")
    return found.select("doc_id", F.col("x.tokens").cast("long").alias("tokens"), F.col("x.chars").cast("long").alias("chars"), "x.starts")


def token_counts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.size(tokens_of()).alias("tokens"))


def offset_to_token(s: SparkSession, d: str) -> DataFrame:
    offsets = F.array_distinct(F.array(F.lit(0), F.floor(F.length("text") / 2).cast("int"), F.length("text")))
    each = F.transform(offsets, lambda o: F.struct(o.alias("offset"), tx.token_at(F.col("text"), o).alias("pos")))
    return docs(s, d).select("doc_id", F.inline(each))


def truncated_tokens(s: SparkSession, d: str) -> DataFrame:
    """Each violating text cut at its violation, as a backtrack leaves it."""
    cut = F.array_join(F.slice(tokens_of(), F.lit(1), F.col("token")), "")
    return earliest()(s, d).select("doc_id", "token", F.sha2(cut, 256).alias("kept_sha256"))


def decode_tokens(s: SparkSession, d: str) -> DataFrame:
    """All texts as tokenizers write their tokens, decoded again."""
    marked = F.transform(tokens_of(), lambda t: F.translate(t, " \n", "ĠĊ"))
    return docs(s, d).select("doc_id", F.sha2(decode.text_of(decode.decode(marked)), 256).alias("text_sha256"))


# Candidates: each vector stands for the logits of one position.


def positions(s: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v, i: F.struct(F.concat(F.when(i % 5 == 0, "*t").otherwise("t"), i.cast("string")).alias("token"), (v.cast("double") * 10.0).alias("x")))
    raw = table(s, d, "embeddings").select("vec_id", x.alias("c"))
    total = F.log(F.aggregate("c", F.lit(0.0), lambda a, y: a + F.exp(y["x"])))
    found = raw.select("vec_id", tx.let(total, lambda z: F.transform("c", lambda y: F.struct(y["token"].alias("token"), (y["x"] - z).alias("logp")))).alias("candidates"))
    best = F.array_min(F.transform("candidates", lambda y: F.struct((-y["logp"]).alias("m"), y["token"].alias("token"))))["token"]
    return found.withColumn("banned", best)


def spread(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.explode(column).alias("c")).select("vec_id", "c.token", F.round("c.p", 6).alias("p"))


def softmax_temperature(s: SparkSession, d: str) -> DataFrame:
    return spread(positions(s, d).withColumn("k", cd.softmax(F.col("candidates"), 0.7)), "k")


def one_filter(f):
    return lambda s, d: spread(positions(s, d).withColumn("k", f(cd.without(cd.softmax(F.col("candidates"), 0.7), F.col("banned")))), "k")


def tried(s: SparkSession, d: str) -> DataFrame:
    """Positions, where even ones have tried what the first rung leaves, and every fourth all but the last candidate."""
    first = cd.filtered(F.col("candidates"), F.col("banned"), LADDER[0])
    names = lambda a: F.transform(a, lambda c: c["token"])
    by_logp = cd.ranked(F.transform("candidates", lambda c: F.struct(c["token"].alias("token"), F.exp(c["logp"]).alias("p"))))
    return positions(s, d).withColumn("tried", F.when(F.col("vec_id") % 4 == 0, names(F.slice(by_logp, 1, 63))).when(F.col("vec_id") % 2 == 0, names(first)).otherwise(F.array().cast("array<string>")))


def relax_ladder(s: SparkSession, d: str) -> DataFrame:
    out = cd.laddered(tried(s, d), "banned", "tried", LADDER)
    return out.select("vec_id", "rung", F.size("kept").alias("kept"), F.element_at("kept", 1)["token"].alias("best"))


def invert_probs(s: SparkSession, d: str) -> DataFrame:
    return spread(positions(s, d).withColumn("k", cd.inverted(cd.filtered(F.col("candidates"), F.col("banned"), LADDER[1]))), "k")


def weighted_choice(s: SparkSession, d: str) -> DataFrame:
    kept = positions(s, d).withColumn("kept", cd.filtered(F.col("candidates"), F.col("banned"), LADDER[1]))
    return kept.select("vec_id", cd.choose(F.col("kept"), F.col("vec_id")).alias("chosen"))


def tails(s: SparkSession, d: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    return positions(s, d).withColumn("tail", cd.tail(F.col("candidates"), F.col("banned"), prefixes=prefixes)).withColumn("tail", F.transform("tail", lambda c: c["token"]))


def tail_candidates(s: SparkSession, d: str) -> DataFrame:
    return tails(s, d).select("vec_id", F.array_join("tail", " ").alias("tail"))


def rule_table(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("text").alias("rule"))


def banned_prefixes(s: SparkSession, d: str) -> DataFrame:
    return cd.rule_prefixes(rule_table(s, d))


def first_token_prefixes(s: SparkSession, d: str) -> DataFrame:
    return cd.first_token_prefixes(rule_table(s, d))


def tail_without_prefixes(s: SparkSession, d: str) -> DataFrame:
    return tails(s, d, tuple(sorted(cd.prefix_set(PREFIX_RULES)))).select("vec_id", F.array_join("tail", " ").alias("tail"))


def select_tail(s: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("token"), (v.cast("double") * 10.0).alias("logit")))
    rows = table(s, d, "embeddings").select("vec_id", x.alias("logits")).where("logits is not null")
    return rows.select("vec_id", F.array_join(F.transform(cd.select_tail(F.col("logits"), 0.9, 0.05, 30, 10), lambda c: c["token"]), " ").alias("tail"))


def token_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each violation with the candidates recorded for its very position: a join by document and position."""
    vectors = table(s, d, "embeddings").count()
    places = batch.numbered(table(s, d, "embeddings").select("vec_id"), "vec_id", "place")
    options = tails(s, d).select("vec_id", "tail", F.element_at(cd.filtered(F.col("candidates"), F.col("banned"), LADDER[4]), 1)["token"].alias("chosen")).join(places, "vec_id")
    # What a run records: for each document and position, which candidates it had. Vectors stand for them in turn. Only the violations' places are read, one a text, so no token is shuffled.
    found = earliest()(s, d).select("doc_id", F.col("token").alias("pos"), "kind", "rule", F.get(tokens_of(), F.col("token")).alias("token"))
    recorded = found.where("token is not null").withColumn("place", F.pmod(F.col("doc_id") * 7 + F.col("pos"), F.lit(max(1, vectors))))
    return recorded.join(options, "place").select("doc_id", "pos", "kind", "rule", F.col("token").alias("rejected"), "chosen", F.array_join("tail", " ").alias("tail"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    """Every violating document has candidates, ``generation`` is all text before the token, the context is the prompt and that text."""
    places = batch.numbered(table(s, d, "embeddings").select("vec_id"), "vec_id", "place")
    chosen = tails(s, d).select("vec_id", "tail", F.element_at(cd.filtered(F.col("candidates"), F.col("banned"), LADDER[4]), 1)["token"].alias("chosen")).join(places, "vec_id")
    e = earliest()(s, d).withColumn("place", F.pmod("doc_id", F.lit(max(1, table(s, d, "embeddings").count()))))
    told = e.withColumn("split", tx.let(tokens_of(), lambda t: F.struct(F.array_join(F.slice(t, F.lit(1), F.col("token")), "").alias("before"), F.get(t, F.col("token")).alias("rejected"))))
    prompt = F.col("doc_id").cast("string")
    return told.join(chosen, "place").select(
        prompt.alias("prompt"), F.col("split.before").alias("generation"), F.concat(prompt, "split.before").alias("context"),
        "split.rejected", "chosen", "tail", "kind", "rule", F.size(F.split("rule", " ")).alias("n"), "doc_id",
    )


def flat_pairs(df: DataFrame) -> DataFrame:
    return df.select("prompt_raw", "generation_raw", "context_with_chat_template", "chosen_decoded", "rejected_decoded", F.array_join("multi_chosen_decoded", " ").alias("multi_chosen"), F.col("validator.class").alias("class"), F.col("validator.subtype").alias("subtype"))


def preference_pairs(s: SparkSession, d: str) -> DataFrame:
    return flat_pairs(pairs.pairs(decisions(s, d)))


def pair_dedup(s: SparkSession, d: str) -> DataFrame:
    made = pairs.pairs(decisions(s, d)).withColumn("sequence", F.col("prompt_raw").cast("long"))
    return flat_pairs(pairs.last_per_context(made.drop("stats"), "sequence"))


# Metrics


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("tokens", (F.col("event_id") % 7 + 1).cast("long"))


def rate_5s_burst(s: SparkSession, d: str) -> DataFrame:
    """Events lie minutes apart, so time runs 12,000 times faster here: a minute is 5 ms."""
    per = events(s, d).withColumn("us", F.floor(F.col("us") / 12_000)).groupBy("user_id", "us").agg(F.sum("tokens").alias("tokens"))
    return metrics.smoothed_rate(per, "user_id").withColumn("rate", F.round("rate", 9))


def chunk_throughput(s: SparkSession, d: str) -> DataFrame:
    t = events(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("chunk"), (F.col("event_id") * 3).alias("ctx_len"), (F.col("event_id") % 5 / 2.0).alias("api_sec"))
    return metrics.chunk_throughput(t).select("run_id", "chunk", "tokens_per_sec")


def run_totals(s: SparkSession, d: str) -> DataFrame:
    return metrics.run_totals(events(s, d), "user_id").withColumn("tokens_per_sec", F.round("tokens_per_sec", 9))


def profile_zones(s: SparkSession, d: str) -> DataFrame:
    z = metrics.zones(events(s, d).select(F.col("event_type").alias("label"), F.col("value").alias("sec")))
    return z.withColumn("seconds", F.round("seconds", 4)).withColumn("ms_per_call", F.round("ms_per_call", 4))


# Loops


def fixpoint_backtrack(s: SparkSession, d: str) -> DataFrame:
    """All texts, each banned word's token replaced by the likeliest candidate; the provider then goes on with the text as it was."""
    rows = docs(s, d).select("doc_id", F.col("text").alias("prompt"), F.array().cast("array<string>").alias("tokens"), F.array().cast("array<array<struct<token:string,logp:double>>>").alias("candidates"))
    done = repair.repair(rows, match.Rules(BANNED_WORDS), standins.Recited(OPTIONS, chunk=1 << 20), repair.ladder_weights(top_k=1))
    return done.select("doc_id", F.size("tokens").alias("tokens"), F.size("events").alias("events"), "settled", F.sha2("text", 256).alias("text_sha256"))


def refuses():
    """A stand-in for a classifier of refusals."""
    return lambda prompts_, answers: [("Refusal", 0.9) if len(p) % 5 == 0 else ("ok", 0.99) for p in prompts_]


def run_rows(s: SparkSession, d: str) -> DataFrame:
    settings = config.merged(config.Config(), {"chunk_size": 20, "top_k": 1, "min_p": None, "invert_probs": False, "enable_refusal_detection": True, "prompt_template": "Go on: {prompt}"})
    return generate.generate(prompts(s, d), settings, match.Rules(BANNED_WORDS), standins.Recited(OPTIONS), existing(s, d), refused(s, d), refuses, None)


def run_log(s: SparkSession, d: str) -> DataFrame:
    """The run: what is done and refused left out, the rest completed, repaired, scored, and logged beside placeholders."""
    return run_rows(s, d).select("prompt_id", "prompt", "generation", "status", "error", F.size("events").alias("events"), "tokens_generated_prompt", "refusal_detected", F.size("ftpo_samples").alias("pairs"), "settled")


def run_pairs(s: SparkSession, d: str) -> DataFrame:
    """The pairs of the run, and where in its text each was made."""
    return generate.pair_rows(run_rows(s, d)).select("prompt_raw", "generation_raw", "context_with_chat_template", "chosen_decoded", "rejected_decoded", F.array_join("multi_chosen_decoded", "|").alias("multi_chosen"))


def stream_rate_watermarked(s: SparkSession, d: str) -> DataFrame:
    """The streaming rate's plan, run over the whole table as one batch of event time."""
    from plumbline.streaming import live

    return live.rates(events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "1 hour", "1 hour")


def vocabulary_diversity(s: SparkSession, d: str) -> DataFrame:
    return profile.diversity(docs(s, d))


QUERIES = {
    "unigram_topk": top(1, 2000),
    "bigram_topk": top(2, 1000),
    "trigram_topk": top(3, 1000),
    "ngram_vs_human_matched": lambda s, d: profile.matched(compared(s, d)),
    "ngram_vs_human_gen_only": lambda s, d: profile.gen_only(compared(s, d)),
    "human_ngram_normalize": human_ngram_normalize,
    "vocabulary_diversity": vocabulary_diversity,
    "ban_refinement": ban_refinement,
    "first_user_prompt": first_user_prompt,
    "first_assistant_turn": lambda s, d: batch.first_assistant(turns(s, d)),
    "text_prompt_filter": lambda s, d: docs(s, d).where(batch.plain_text(F.col("text"))).select("doc_id"),
    "render_prompt": render_prompt,
    "render_chat": render_chat,
    "classifier_input": classifier_input,
    "number_prompts": prompts,
    "resume_pending": lambda s, d: batch.pending(prompts(s, d), existing(s, d), refused(s, d)).select("prompt_id", "prompt"),
    "resume_pending_limited": lambda s, d: batch.pending(prompts(s, d), existing(s, d), refused(s, d), limit=10).select("prompt_id", "prompt"),
    "refusal_ids": refused,
    "refusal_placeholders": placeholders,
    "run_log_union": run_log_union,
    "refusal_decision": refusal_decision,
    "phrase_first_hit": one_kind(match.phrase_first),
    "phrase_all_hits": phrase_all_hits,
    "regex_first_hit": one_kind(match.regex_first),
    "regex_lookahead_hit": regex_lookahead_hit,
    "ngram_first_hit": one_kind(match.ngram_first),
    "ngram_hit_counts": ngram_hit_counts,
    "earliest_violation": earliest_violation,
    "earliest_skip_regex": lambda s, d: earliest((match.REGEX,))(s, d).drop("text", "hit"),
    "violation_snippet": violation_snippet,
    "ban_event_message": ban_event_message,
    "unsuppressed_violation": left_of(resolve.first_unsuppressed),
    "masked_violation": left_of(resolve.first_masked),
    "token_offsets": token_offsets,
    "offset_to_token": offset_to_token,
    "token_counts": token_counts,
    "truncated_tokens": truncated_tokens,
    "joined_parts": joined_parts,
    "decode_tokens": decode_tokens,
    "softmax_temperature": softmax_temperature,
    "min_p": one_filter(lambda p: cd.min_p(p, 0.3)),
    "top_p": one_filter(lambda p: cd.top_p(p, 0.3)),
    "top_k": one_filter(lambda p: cd.top_k(p, 5)),
    "relax_ladder": relax_ladder,
    "invert_probs": invert_probs,
    "weighted_choice": weighted_choice,
    "tail_candidates": tail_candidates,
    "banned_prefixes": banned_prefixes,
    "first_token_prefixes": first_token_prefixes,
    "tail_without_prefixes": tail_without_prefixes,
    "select_tail": select_tail,
    "token_pairs": token_pairs,
    "preference_pairs": preference_pairs,
    "pair_dedup": pair_dedup,
    "rate_5s_burst": rate_5s_burst,
    "chunk_throughput": chunk_throughput,
    "run_totals": run_totals,
    "profile_zones": profile_zones,
    "fixpoint_backtrack": fixpoint_backtrack,
    "run_log": run_log,
    "run_pairs": run_pairs,
    "stream_rate_watermarked": stream_rate_watermarked,
} | sourced.QUERIES
ORACLES = oracles.ORACLES | sourced.ORACLES
FLAGSHIP = earliest_violation
