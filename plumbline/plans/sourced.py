"""Queries over sources and sinks: the driver's tables are written as records of the engine's own kinds, and read back through its readers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config, generate
from plumbline.functions import text as tx
from plumbline.operators import batch, decode, match, refusal
from plumbline.operators.repair import ProviderError
from plumbline.plans import oracles, standins
from plumbline.plans.oracles import BANNED_WORDS, OPTIONS, REGEXES
from plumbline.sources import completions, records
from plumbline.sources.recorded import RecordedEvents
from plumbline.sources.shared import place
from plumbline.sources.tables import table
from plumbline.streaming import live


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def regex_timed_hit(s: SparkSession, d: str) -> DataFrame:
    """The patterns with a limit of time for each text: all texts stay within it."""
    rows = match.regex_first_timed(_texts(s, d), match.Rules(regexes=REGEXES), seconds=60.0)
    return rows.where("hit is not null and not timed_out").select("doc_id", "hit.kind", "hit.start", "hit.length", "hit.rule", "hit.match")


def decode_byte_tokens(s: SparkSession, d: str) -> DataFrame:
    """All texts as tokens, those of ASCII in a byte alphabet, decoded."""
    ascii_, boxes = "".join(map(chr, range(128))), "".join(chr(decode.BOXES + b) for b in range(128))
    tokens = F.transform(F.regexp_extract_all("text", F.lit(tx.TOKEN), F.lit(0)), lambda t: F.when(F.octet_length(t) == F.length(t), F.translate(t, ascii_, boxes)).otherwise(t))
    return _texts(s, d).select("doc_id", F.sha2(decode.text_of(decode.decode(tokens)), 256).alias("text_sha256"))


def _log(s: SparkSession, d: str) -> str:
    """Where a log of generations was written: documents with labels; toxic ones refused, poor ones failed."""
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id")
    log = rows.select(F.col("doc_id").cast("string").alias("prompt_id"), F.concat(F.lit("p "), "source").alias("prompt"), F.col("text").alias("generation"), F.when(F.col("quality") == 0, "failed").otherwise("success").alias("status"), (F.col("toxic") == 1).alias("refusal_detected"), F.lit("pairs").alias("ftpo_samples"))
    path = place(s, "log")
    records.append_generations(log, path)
    records.append_generations(log.limit(0), path)  # a part without rows
    return path


def generation_log(s: SparkSession, d: str) -> DataFrame:
    """A log that was written and read."""
    rows = records.generations(s, _log(s, d))
    return rows.select("prompt_id", "prompt", F.sha2("generation", 256).alias("generation_sha256"), "status", "refusal_detected")


def log_refusals(s: SparkSession, d: str) -> DataFrame:
    """What a log says was refused."""
    return records.refusals(s, _log(s, d))


def log_ids(s: SparkSession, d: str) -> DataFrame:
    """What a log says is done."""
    return records.log_ids(s, _log(s, d))


def _dataset(s: SparkSession, d: str) -> str:
    """Where a dialogue dataset was written, with a split ``train``; a third of it as rows with a prompt only, a third with a text only."""
    turns = table(s, d, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.min_by("text", "turn").alias("first"))
    said = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    kind = F.col("conv_id") % 3
    rows = whole.select(F.when(kind == 0, said).alias("conversations"), F.when(kind == 1, F.col("first")).alias("prompt"), F.when(kind == 2, F.col("first")).alias("text"))
    path = place(s, "dataset")
    rows.write.json(f"{path}/train")
    rows.limit(1).write.json(f"{path}/test")
    return path


def dataset_prompts(s: SparkSession, d: str) -> DataFrame:
    """The prompts of a dataset on disk."""
    rows = records.dataset(s, _dataset(s, d))
    return rows.select(batch.prompt_of(F.col("conversations"), F.col("prompt"), F.col("text")).alias("prompt")).where("prompt is not null")


def run_in_waves(s: SparkSession, d: str) -> DataFrame:
    """A whole run by a settings file's settings: a dataset in, ban lists from files, waves, a log and pairs on disk; the log as it was read back."""
    where = place(s, "run")
    s.createDataFrame([('[["%s", 1.0]]' % '", 1.0], ["'.join(BANNED_WORDS),)], "value string").coalesce(1).write.text(f"{where}/phrases")
    settings = config.merged(config.Config(), {
        "input_hf_dataset": _dataset(s, d), "output_jsonl": f"{where}/log", "ftpo_pairs_jsonl": f"{where}/pairs", "slop_phrases_file": f"{where}/phrases", "generation_params": {"top_k": 1, "min_p": None},
        "invert_probs": False, "wave_prompts": 1000, "threads": 4, "enable_refusal_detection": True,
    })
    scorer = lambda: refusal.LogitScorer(refusal.Words(), lambda rows: [[1.0, 0.0] if len(r) < 12 else [0.0, 1.0] for r in rows], ("short", "long"))
    generate.run(s, settings, standins.Recited(OPTIONS), scorer)
    pairs = s.read.schema("prompt_raw string, generation_raw string").json(f"{where}/pairs/run=*/wave=*") if records.exists(s, f"{where}/pairs") else s.createDataFrame([], "prompt_raw string, generation_raw string")
    many = pairs.groupBy("prompt_raw").agg(F.count("*").alias("all_pairs"))
    log = records.generations(s, f"{where}/log")
    per = log.groupBy("prompt").agg(F.count("*").alias("texts"), F.sum(F.size("events")).alias("events"), F.min(F.sha2("generation", 256)).alias("generation_sha256"), F.min("status").alias("status"), F.min("refusal_label").alias("label"))
    return per.join(many, per["prompt"] == many["prompt_raw"], "left").select("prompt", "texts", "events", F.coalesce("all_pairs", F.lit(0)).cast("long").alias("pairs"), "generation_sha256", "status", "label")


def _events(s: SparkSession, d: str) -> str:
    """Where recorded streams were written: each turn an event, some lines malformed, comments between."""
    token = F.concat(F.lit(" "), F.col("role"))
    choice = F.struct(F.col("text"), F.when(F.col("turn") % 2 == 0, "length").otherwise("stop").alias("finish_reason"), F.struct(F.array(F.col("text"), token).alias("tokens"), F.array(F.create_map(F.col("text"), F.lit(-0.5)), F.create_map(token, F.lit(-1.5))).alias("top_logprobs")).alias("logprobs"))
    line = F.when(F.col("conv_id") % 11 == 0, ": ping").when(F.col("conv_id") % 13 == 0, "data: {broken").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices")))))
    path = place(s, "events")
    table(s, d, "conversations").where("text is not null and role is not null").select(line.alias("value")).write.text(path)
    return path


def _told(events: DataFrame) -> DataFrame:
    tops = F.array_join(F.transform(F.flatten(F.map_values("logprobs")), lambda x: F.concat(F.length(x["token"]).cast("string"), F.lit(":"), x["logp"].cast("string"))), " ")
    return events.select(F.sha2("generated_text", 256).alias("text_sha256"), F.size("token_strings").alias("tokens"), tops.alias("tops"), "finish_reason")


def recorded_events(s: SparkSession, d: str) -> DataFrame:
    """The events of recorded streams, read as a table."""
    s.dataSource.register(RecordedEvents)
    return _told(s.read.format("recorded_events").option("path", _events(s, d)).load())


def streamed_events(s: SparkSession, d: str) -> DataFrame:
    """The same read as a stream, to its end."""
    s.dataSource.register(RecordedEvents)
    out, at = place(s, "streamed"), place(s, "offsets")
    query = s.readStream.format("recorded_events").option("path", _events(s, d)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _told(s.read.parquet(out))


def edited_lists(s: SparkSession, d: str) -> DataFrame:
    """Conversations as token lists that are appended to, changed and cut back, edit by edit, in keyed state."""
    turns = table(s, d, "conversations").where("conv_id is not null and turn is not null")
    every = F.array(
        F.struct(F.lit("append").alias("op"), F.lit(None).cast("int").alias("at"), F.col("text").alias("token"), F.lit(0).alias("k")),
        F.struct(F.when(F.col("turn") % 3 == 1, "replace").otherwise("truncate").alias("op"), F.when(F.col("turn") % 3 == 1, 0).otherwise(1 << 20).cast("int").alias("at"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("token"), F.lit(1).alias("k")),
    )
    edits = turns.select(F.col("conv_id").alias("doc_id"), "turn", F.explode(every).alias("e")).select("doc_id", (F.col("turn") * 2 + F.col("e.k")).alias("seq"), "e.op", "e.at", "e.token")
    path, out, at = place(s, "edits"), place(s, "lists"), place(s, "state")
    edits.write.json(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = s.conf.get(key)
    live.use_rocks(s)
    try:
        changes = live.edited(s.readStream.schema(live.EDITS).json(path))
        query = changes.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        s.conf.set(key, old)
    lists = live.lists(s.read.schema(live.CHANGES).parquet(out))
    return lists.select(F.col("doc_id").alias("conv_id"), F.size("tokens").alias("tokens"), F.sha2("text", 256).alias("text_sha256"))


class _Service:
    """A service that repeats a prompt, and refuses some."""

    @staticmethod
    def connect(provider: Any, settings: Any) -> completions.Http:
        def post(body: dict[str, Any]) -> dict[str, Any]:
            prompt = body["prompt"]
            if len(prompt) % 7 == 0:
                raise ProviderError("400: too long")
            logprobs = {"content": [{"token": prompt, "top_logprobs": [{"token": prompt, "logprob": -0.25}, {"token": "!", "logprob": -2.0}]}]} if len(prompt) % 2 else {"tokens": [prompt], "top_logprobs": [{prompt: -0.25}]}
            return {"choices": [{"text": prompt + "!", "finish_reason": "length", "logprobs": logprobs}]}

        return completions.Http(post)


def completed_chunks(s: SparkSession, d: str) -> DataFrame:
    """A chunk of each conversation's first prompt from a stand-in for a service, whose answers have two shapes and which fails at times."""
    prompts = batch.first_human(table(s, d, "conversations")).select(F.col("conv_id").alias("prompt_id"), "prompt")
    found = completions.complete(prompts, config.Provider(model_name="m"), config.Generation(), _Service.connect)
    return found.select("prompt_id", F.length("generated_text").alias("chars"), F.size("token_strings").alias("tokens"), F.size(F.coalesce(F.element_at("logprobs", 0), F.array().cast("array<struct<token:string,logp:double>>"))).alias("candidates"), "finish_reason", "error")


def timing_table(s: SparkSession, d: str) -> DataFrame:
    """Timings written as CSV and read as the latest of a folder."""
    rows = table(s, d, "events").select(F.col("event_id").cast("int").alias("chunk"), (F.col("event_id") * 3 % 1000).cast("int").alias("ctx_len"), (F.col("event_id") % 5 / 2.0).alias("api_sec"), (F.col("event_id") % 3 / 4.0).alias("validators_sec"))
    path = place(s, "timings")
    records.write_timings(rows.coalesce(1), path)
    found = records.latest_timings(s, path)
    return found.groupBy("api_sec", "validators_sec").agg(F.count("*").alias("chunks"), F.sum("ctx_len").alias("ctx_len"))


def human_profile_terms(s: SparkSession, d: str) -> DataFrame:
    """A profile file of benchmark items' pairs of words, read and made into terms."""
    raw = F.split("text", " ")
    pairs = F.transform(F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(raw, i + 1)))
    items = table(s, d, "benchmark").where("text is not null").select(F.explode(pairs).alias("ngram"), (F.col("item_id") % 3 + 1.0).alias("frequency"))
    # A profile is one JSON document, of a table of items that is small by nature.
    whole = items.agg(F.collect_list(F.struct("ngram", "frequency")).alias("top_bigrams"), F.lit(4.0).alias("num_texts_analyzed"), F.lit(25.0).alias("avg_length"))
    path = place(s, "profile")
    whole.select(F.struct("num_texts_analyzed", "avg_length", "top_bigrams").alias("human-authored")).write.json(path)
    from plumbline.operators import profile

    found, chars = records.human_profile(s, path, 2)
    return profile.normalized_profile(found, 2).join(F.broadcast(chars)).select("term", "count", "chars")


_token = oracles.TOKEN_SQL
_banned = oracles.BANNED_SQL
_kept = "conv_id % 11 <> 0 AND conv_id % 13 <> 0 AND text IS NOT NULL AND role IS NOT NULL"
_event_sql = f"SELECT sha256(text) AS text_sha256, 2 AS tokens, length(text)::VARCHAR || ':-0.5 ' || (length(role) + 1)::VARCHAR || ':-1.5' AS tops, CASE WHEN turn % 2 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM conversations WHERE {_kept}"
_logged = "logged AS (SELECT doc_id, source, text, quality, toxic FROM labels JOIN documents USING (doc_id))"
_data = """rows_ AS (SELECT conv_id, arg_min(text, turn) AS first, arg_min(text, turn) FILTER (WHERE role = 'user') AS said FROM conversations GROUP BY conv_id),
data AS (SELECT CASE conv_id % 3 WHEN 0 THEN said WHEN 1 THEN first ELSE CASE WHEN contains(lower(first), 'assistant:') OR contains(lower(first), 'bot:') OR contains(lower(first), 'gpt:') OR contains(first, chr(10) || chr(10)) THEN NULL ELSE first END END AS prompt FROM rows_)"""

QUERIES = {
    "regex_timed_hit": regex_timed_hit,
    "decode_byte_tokens": decode_byte_tokens,
    "generation_log": generation_log,
    "log_refusals": log_refusals,
    "log_ids": log_ids,
    "dataset_prompts": dataset_prompts,
    "run_in_waves": run_in_waves,
    "recorded_events": recorded_events,
    "streamed_events": streamed_events,
    "edited_lists": edited_lists,
    "completed_chunks": completed_chunks,
    "timing_table": timing_table,
    "human_profile_terms": human_profile_terms,
}
ORACLES = {
    "regex_timed_hit": oracles.ORACLES["regex_first_hit"],
    "decode_byte_tokens": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "generation_log": f"WITH {_logged} SELECT doc_id::VARCHAR AS prompt_id, 'p ' || source AS prompt, sha256(text) AS generation_sha256, CASE WHEN quality = 0 THEN 'failed' ELSE 'success' END AS status, toxic = 1 AS refusal_detected FROM logged",
    "log_refusals": f"WITH {_logged} SELECT DISTINCT doc_id::VARCHAR AS prompt_id FROM logged WHERE toxic = 1 OR quality = 0 OR coalesce(text, '') = ''",
    "log_ids": f"WITH {_logged} SELECT doc_id::VARCHAR AS prompt_id FROM logged",
    "dataset_prompts": f"WITH {_data} SELECT prompt FROM data WHERE coalesce(prompt, '') <> ''",
    "run_in_waves": f"""WITH {_data}, cut AS (SELECT prompt, regexp_extract_all(prompt, '{_token}')[1:1200] AS ts FROM data WHERE coalesce(prompt, '') <> ''),
recited AS (SELECT prompt, list_transform(ts, lambda t: CASE WHEN regexp_matches(lower(t), '{_banned}') THEN ' stone' ELSE t END) AS new, len(list_filter(ts, lambda t: regexp_matches(lower(t), '{_banned}'))) AS n FROM cut),
judged AS (SELECT *, array_to_string(new, '') AS generation, string_split(prompt, ' ') AS u, string_split(array_to_string(new, ''), ' ') AS a FROM recited),
sized AS (SELECT *, least(len(u), 100) + len(a) - 1 AS words FROM judged)
SELECT prompt, count(*) AS texts, sum(n)::BIGINT AS events, sum(n)::BIGINT AS pairs, min(sha256(generation)) AS generation_sha256, 'success' AS status, min(CASE WHEN words < 12 THEN 'short' ELSE 'long' END) AS label FROM sized GROUP BY prompt""",
    "recorded_events": _event_sql,
    "streamed_events": _event_sql,
    "edited_lists": """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, list(coalesce(text, '') ORDER BY r) AS ts, arg_max('t' || turn::VARCHAR, turn) FILTER (WHERE turn % 3 = 1) AS head FROM t GROUP BY conv_id)
SELECT conv_id, len(ts)::INT AS tokens, sha256(coalesce(head, ts[1]) || array_to_string(ts[2:], '')) AS text_sha256 FROM l""",
    "completed_chunks": f"""WITH {oracles.PROMPTS_SQL} SELECT conv_id AS prompt_id, CASE WHEN length(prompt) % 7 = 0 THEN 0 ELSE length(prompt) + 1 END::INT AS chars, CASE WHEN length(prompt) % 7 = 0 THEN 0 ELSE 1 END::INT AS tokens,
CASE WHEN length(prompt) % 7 = 0 THEN 0 WHEN length(prompt) % 2 = 1 THEN 2 ELSE 1 END::INT AS candidates, CASE WHEN length(prompt) % 7 = 0 THEN 'error' ELSE 'length' END AS finish_reason, CASE WHEN length(prompt) % 7 = 0 THEN '400: too long' END AS error FROM prompts""",
    "timing_table": "SELECT event_id % 5 / 2.0::DOUBLE AS api_sec, event_id % 3 / 4.0::DOUBLE AS validators_sec, count(*) AS chunks, sum(event_id * 3 % 1000)::BIGINT AS ctx_len FROM events GROUP BY 1, 2",
    "human_profile_terms": oracles.ORACLES["human_ngram_normalize"].replace("sum(frequency)::BIGINT AS count", "sum(frequency)::DOUBLE AS count, 100.0::DOUBLE AS chars"),
}
