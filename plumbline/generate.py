"""The run itself: prompts in, a log of generations and preference pairs out.

Prompts that the log has, or that were refused before, are left out; the rest are completed by a
provider, checked and repaired as they grow, scored for refusal, and become rows of the log, with
a row for each refused prompt. All but the loop over one text is DataFrame operations.

A run works in waves of prompts, a micro-batch each: a wave's rows are written once, and from these
its part of the log and of the pairs, each a folder named for the wave, so that a wave that is
committed twice is there once. Some waves are under way at once, each in a lane of its own; a run that
was broken off goes on, in each lane, with the first wave that is not committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.config import Config
from plumbline.operators import batch, repair
from plumbline.operators.candidates import prefix_set
from plumbline.operators.match import Rules
from plumbline.operators.pairs import pairs
from plumbline.operators.refusal import Scorer, Tokenizer, Words, judged
from plumbline.sources import completions, records, templates
from plumbline.sources import rules as lists



def prefixes(rules: Rules) -> frozenset[str]:
    """How phrases and n-grams begin, with and without a blank: what a candidate must not be."""
    return prefix_set([*rules.phrases, *(" ".join(g) for g in rules.ngrams)])


def sampling(config: Config) -> Callable[[repair.Candidates, str, int], list[repair.Candidates]]:
    """How candidates are weighed, by the settings."""
    g = config.generation
    return repair.ladder_weights(g.temperature, g.min_p, g.top_p, g.top_k, config.backtracking.force_backtrack, g.invert_probs)


def provider_of(config: Config, connect: Callable[..., completions.Http] = completions.http) -> Callable[[], Any]:
    """Makes the service that the settings name, in each task."""
    kind = completions.StreamingService if config.generation.request_mode == "stream" else completions.Service
    return lambda: kind(config.provider, config.generation, connect(config.provider, config.generation))


def scored(rows: DataFrame, scorer: Callable[[], Scorer]) -> DataFrame:
    """``prompt_id, label, confidence`` of ``rows(prompt_id, prompt, generation)``. A scorer that can't be made, or fails, says ``error`` with confidence 0."""
    return judged(rows.select("prompt_id", "prompt", "generation"), scorer, "prompt", "generation").select("prompt_id", "label", "confidence")


def completed(prompts: DataFrame, config: Config, rules: Rules, provider: Any, **more: Any) -> DataFrame:
    """``prompts(prompt_id, prompt)`` with a repaired completion each, as ``repair.REPAIRED`` and ``prompt``."""
    prompt = F.col("prompt")
    if config.chat_prefix is not None:
        prompt = batch.chat(prompt, F.lit(""), config.system_prompt, config.chat_prefix, config.chat_middle)
    nothing = [F.array().cast("array<string>").alias("tokens"), F.array().cast("array<array<struct<token:string,logp:double>>>").alias("candidates")]
    begun = prompts.where("prompt_id is not null").select(F.col("prompt_id").alias("doc_id"), prompt.alias("prompt"), F.col("prompt").alias("asked"), *nothing)
    banned = prefixes(rules) if config.filter_tail_banned_prefix_tokens else frozenset()
    done = repair.repair(
        begun, rules, provider, sampling(config), repair.tail_of(most=config.tail_top_k, limit=config.max_chosen_tokens, share=config.generation.min_p or 0.01, prefixes=banned), config.seed,
        max_tokens=config.generation.max_new_tokens, retries=config.backtracking.max_retries_per_position, interval=config.regex_validation_interval, in_flight=config.threads, kept=("asked",), **more,
    )
    return done.withColumnsRenamed({"doc_id": "prompt_id", "asked": "prompt"})


def log_rows(done: DataFrame, config: Config) -> DataFrame:
    """Completions as rows of the log, with ``ftpo_samples``; those that a scorer (``label``, ``confidence``) takes for refusals fail, keep their text and lose their pairs."""
    rows = done.withColumnsRenamed({"text": "generation", "error": "service_error"}).withColumn("status", F.lit("success")).withColumn("tokens_generated_prompt", F.size("tokens").cast("long"))
    if "label" not in done.columns:
        none = {"refusal_detected": F.lit(False), "keep_pairs": F.lit(True), "label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "scorer_error": F.lit(None).cast("string")}
        found = rows.withColumns(none)
    else:
        found = batch.decided(rows, config.refusal_threshold, config.enable_refusal_detection)
    samples = F.when(F.col("keep_pairs"), F.col("samples")).otherwise(F.array().cast(f"array<{repair.SAMPLE}>"))
    kept = F.transform("events", lambda e: e.dropFields("chosen"))
    return found.select(
        F.col("prompt_id").cast("string").alias("prompt_id"), "prompt", "generation", "status", F.when(F.col("refusal_detected"), F.format_string("refusal detected (%s, p=%.3f)", "label", "confidence")).otherwise(F.col("service_error")).alias("error"), kept.alias("events"), "tokens_generated_prompt",
        "refusal_detected", F.col("label").alias("refusal_label"), F.col("confidence").alias("refusal_confidence"), F.col("scorer_error").alias("refusal_error"), samples.alias("ftpo_samples"), "settled",
    )


def pair_rows(log: DataFrame) -> DataFrame:
    """The preference pairs of a log's ``ftpo_samples``: of each text, the last captured in each context."""
    x = log.select("prompt", F.explode("ftpo_samples").alias("s"))
    return pairs(x.select("prompt", "s.generation", "s.context", "s.rejected", "s.chosen", "s.tail", "s.kind", "s.rule", "s.n"))


def generate(prompts: DataFrame, config: Config, rules: Rules, provider: Any = None, existing: DataFrame | None = None, refused: DataFrame | None = None, scorer: Callable[[], Scorer] | None = None, tokenizer: Callable[[], Tokenizer] | None = Words, **more: Any) -> DataFrame:
    """Rows to append to the log of ``prompts(prompt_id, prompt)``: a placeholder for each refused prompt without a row, and a row for each prompt that is neither there nor refused.

    ``existing`` and ``refused`` are tables of ``prompt_id``. Nulls: a null prompt is empty. Equal
    ids are one prompt to the log. Rows are in no order. ``tokenizer`` cuts what the scorer reads;
    none: it cuts by itself.
    """
    left, stand_ins = outstanding(prompts, config, existing, refused)
    return batch.run_log(answered(left, config, rules, provider, scorer, tokenizer, **more), stand_ins)


def outstanding(prompts: DataFrame, config: Config, existing: DataFrame | None = None, refused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The prompts that are still to be asked, and the rows that stand for refused ones."""
    none = prompts.sparkSession.createDataFrame([], "prompt_id string")
    existing, refused = existing if existing is not None else none, refused if refused is not None else none
    asked = prompts.withColumn("prompt", batch.templated(F.coalesce("prompt", F.lit("")), config.prompt_template)) if config.prompt_template != "{prompt}" else prompts
    stand_ins = batch.placeholders(refused, existing, asked)
    stand_ins = stand_ins.withColumn("prompt_id", F.col("prompt_id").cast("string")).withColumn("events", F.array().cast(f"array<{records.EVENT}>"))
    return batch.pending(asked, existing, refused, limit=config.max_prompts), stand_ins


def answered(asked: DataFrame, config: Config, rules: Rules, provider: Any = None, scorer: Callable[[], Scorer] | None = None, tokenizer: Callable[[], Tokenizer] | None = Words, **more: Any) -> DataFrame:
    """The log's rows for ``asked(prompt_id, prompt)``: completed, repaired and scored in one pass, so each prompt goes to the service once."""
    done = completed(asked, config, rules, provider if provider is not None else provider_of(config), **more)
    return log_rows(judged(done, scorer, tokenizer=tokenizer) if scorer is not None and config.enable_refusal_detection else done, config)


def read_prompts(spark: SparkSession, config: Config) -> DataFrame:
    """``prompt_id, prompt`` of the source that the settings name: a JSON list, or a dataset on disk."""
    if config.input_json:
        return records.prompt_list(spark, config.input_json)
    if not config.input_hf_dataset:
        raise ValueError("no prompts: input_json or input_hf_dataset is needed")
    rows = records.dataset(spark, config.input_hf_dataset, config.hf_dataset_split, config.hf_dataset_config_name)
    found = rows.select(batch.prompt_of(F.col("conversations"), F.col("prompt"), F.col("text")).alias("prompt"), F.monotonically_increasing_id().alias("at")).where("prompt is not null")
    return batch.numbered(found, "at").select("prompt_id", "prompt")


def rules_of(spark: SparkSession, config: Config) -> Rules:
    """The rules that the settings name."""
    return lists.load(spark, config.bans, config.regex_reach, config.regex_max_span_tokens)


def with_template(spark: SparkSession, config: Config) -> Config:
    """The settings with the literal parts of the chat template in a file, if they name one."""
    if config.chat_template_file is None:
        return config
    prefix, middle = templates.load(spark, config.chat_template_file, config.system_prompt)
    return replace(config, chat_prefix=prefix, chat_middle=middle)


#: What is told of a wave: its number, its rows and tokens, and its events by kind.
Progress = Callable[[dict[str, Any]], None]
#: Bytes of a wave's answers that one task puts into the log, or into the pairs.
PART = 4 << 20
RUN, PROMPTS = "run string, lanes int", "prompt_id long, prompt string"
TOTALS = "prompts long, tokens long, succeeded long, unsettled long"


def in_waves(spark: SparkSession, waves: str, lanes: int | None, answer: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame, str], None]) -> None:
    """Answer and commit what is left of a run's prompts, a file of them at a time in each lane.

    A lane is a stream of its own, so that tasks have other waves' prompts while one is planned or
    committed. Once a wave has failed no lane begins another, and the failure is raised when all
    have ended. ``lanes`` is null where a run was begun without any: its prompts are one stream.
    """
    names = [f"/lane={k}" for k in range(lanes)] if lanes is not None else [""]
    failed: list[Exception] = []
    queries = []

    def begun(lane: str) -> StreamingQuery:
        def wave(rows: DataFrame, number: int) -> None:
            if failed:
                raise RuntimeError("another wave failed")
            try:
                commit(rows, f"{lane.removeprefix('/lane=')}_{number}" if lane else str(number))
            except Exception as why:
                failed.append(why)
                raise

        queue = spark.readStream.schema(PROMPTS).option("maxFilesPerTrigger", 1).parquet(f"{waves}/prompts{lane}")
        rows = answer(queue.repartition(spark.sparkContext.defaultParallelism))
        return rows.writeStream.foreachBatch(wave).option("checkpointLocation", f"{waves}/checkpoint{lane}").trigger(availableNow=True).start()

    try:
        for lane in names:
            if records.exists(spark, f"{waves}/prompts{lane}"):  # there are no more lanes than waves
                queries.append(begun(lane))
        for query in queries:
            try:
                query.awaitTermination()
            except Exception as why:
                failed.append(why)
    finally:
        for query in queries:
            query.stop()
    if failed:
        raise failed[0]


def run(spark: SparkSession, config: Config, provider: Any = None, scorer: Callable[[], Scorer] | None = None, progress: Progress | None = None) -> DataFrame:
    """A whole run by the settings: reads, generates, writes the log and the pairs wave by wave, and gives the totals.

    What is still to be asked is written beside the log, in as many files as there are waves, and
    read as streams of them, ``waves_in_flight`` at once. A run that ended early left this folder:
    the next one goes on with it, whatever its prompts. ``progress`` is called here, on the driver,
    after each wave, one call at a time.
    """
    if not config.output_jsonl:
        raise ValueError("output_jsonl is needed")
    if config.generation.request_mode == "stream" and provider is None and not completions.gives_logprobs(config.provider, config.generation):
        raise RuntimeError("the service gives no log probabilities in streams; use request_mode=chunk")
    rules = rules_of(spark, config)
    config = with_template(spark, config)
    log = config.output_jsonl.rstrip("/")
    waves = f"{log}.waves"
    if not records.exists(spark, f"{waves}/prompts/_SUCCESS"):
        existing = records.log_ids(spark, log)
        refused = records.refusals(spark, config.refusals_file) if config.refusals_file else None
        left, stand_ins = outstanding(read_prompts(spark, config), config, existing, refused)
        lanes = max(1, config.waves_in_flight)
        spark.createDataFrame([(uuid.uuid4().hex, lanes)], RUN).write.mode("overwrite").parquet(f"{waves}/run")
        stand_ins.write.mode("overwrite").parquet(f"{waves}/stand_ins")
        left = left.select(F.col("prompt_id").cast("long").alias("prompt_id"), "prompt")
        files = -(-left.count() // max(1, config.wave_prompts))
        dealt = left.repartition(max(1, files)).withColumn("lane", F.spark_partition_id() % lanes)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lane").parquet(f"{waves}/prompts")
    run_id, lanes = spark.read.schema(RUN).parquet(f"{waves}/run").first()

    telling = Lock()

    def staged(rows: DataFrame, wave: str) -> DataFrame:
        path = f"{waves}/staged/wave={wave}"
        if not records.exists(spark, f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(path)
        # As many tasks as its size needs, not as many as there were: each costs more than a small wave's rows.
        return spark.read.schema(rows.schema).parquet(path).coalesce(1 + records.size(spark, path) // PART)

    def commit(rows: DataFrame, wave: str) -> None:
        written = staged(rows, wave)
        if config.ftpo_pairs_jsonl and "ftpo_samples" in written.columns:
            records.put(pair_rows(written), f"{config.ftpo_pairs_jsonl.rstrip('/')}/run={run_id}/wave={wave}")
        records.put(written.drop("settled", "ftpo_samples"), f"{log}/run={run_id}/wave={wave}")
        if progress is not None:
            kinds = written.select(F.explode("events").alias("e")).groupBy("e.type").count().collect()  # as many as there are kinds of rules
            told = written.agg(F.count("*").alias("prompts"), F.sum("tokens_generated_prompt").alias("tokens")).first()
            with telling:
                progress({"wave": wave, "prompts": told["prompts"], "tokens": told["tokens"] or 0, "events": {r["type"]: r["count"] for r in kinds}})

    stand_ins = spark.read.parquet(f"{waves}/stand_ins")
    if not stand_ins.isEmpty():
        commit(stand_ins, "stand_ins")
    in_waves(spark, waves, lanes, lambda prompts: answered(prompts, config, rules, provider, scorer), commit)
    totals = (0, 0, 0, 0)
    if records.exists(spark, f"{waves}/staged"):
        written = spark.read.option("mergeSchema", "true").parquet(f"{waves}/staged")
        settled = F.coalesce("settled", F.lit(True)) if "settled" in written.columns else F.lit(True)
        totals = tuple(written.agg(F.count("*"), F.coalesce(F.sum("tokens_generated_prompt"), F.lit(0)), F.count_if(F.col("status") == "success"), F.count_if(~settled)).first())
    records.removed(spark, waves)
    return spark.createDataFrame([totals], TOTALS)


def one(prompt: str, config: Config, rules: Rules, provider: Any, on_event: Callable[[int, dict], None] | None = None) -> dict[str, Any]:
    """A single prompt, here and now: the text, its events and pairs. A failure leaves the text so far and says so."""
    settings = repair.Settings(sampling(config), repair.tail_of(prefixes=prefixes(rules)), config.seed, 10_000, config.generation.max_new_tokens, config.backtracking.max_retries_per_position, config.regex_validation_interval, on_event)
    return repair.repair_one(0, config.prompt_template.replace("{prompt}", prompt), [], [], repair.Matcher(rules), provider, settings)

