"""Batch bookkeeping: prompts, resuming, refusals, templates, status rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.sources.shared import written


def first_human(turns: DataFrame, role: str = "user") -> DataFrame:
    """``conv_id, prompt``: the first turn of this role in each conversation, empty ones left out."""
    first = turns.where(F.lower("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return first.where(F.coalesce("prompt", F.lit("")) != "")


def first_assistant(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """``conv_id, output``: the first turn of exactly this role, stripped, empty ones left out."""
    first = turns.where(F.col("role") == role).groupBy("conv_id").agg(strip(F.min_by("text", "turn")).alias("output"))
    return first.where(F.coalesce("output", F.lit("")) != "")


def prompt_of(conversations: Column, prompt: Column, text: Column) -> Column:
    """A record's prompt: the first human turn if it has a list of turns, else its prompt, else its text unless that looks like a dialogue."""
    human = F.get(F.filter(conversations, lambda t: F.lower(t["from"]) == "human"), F.lit(0))["value"]
    found = F.when(conversations.isNotNull(), human).when(prompt.isNotNull(), prompt).when(plain_text(text), text)
    return F.when(found != "", found)


def plain_text(text: Column) -> Column:
    """Whether a text is no dialogue: no speaker marks, no blank line."""
    low = F.lower(text)
    marks = [F.contains(low, F.lit(m)) for m in ("assistant:", "bot:", "gpt:", "\n\n")]
    return ~(marks[0] | marks[1] | marks[2] | marks[3])


def templated(prompt: Column, template: str) -> Column:
    """The prompt in its template. Any placeholder but {prompt} is an error, found before a job starts."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name != "prompt":
                raise ValueError(f"unknown placeholder {{{name}}}")
            parts.append(prompt)
    return F.concat(*parts) if parts else F.lit("")


def chat(prompt: Column, so_far: Column, system: str = "", prefix: str = "<|system|>\n{system}\n<|user|>\n", middle: str = "\n<|assistant|>\n") -> Column:
    """Prompt and answer so far between the literal parts of a chat template."""
    return F.concat(F.lit(prefix.replace("{system}", system)), prompt, F.lit(middle), so_far)


def numbered(df: DataFrame, order: str, into: str = "prompt_id") -> DataFrame:
    """Rows numbered from 0 in the order of a column.

    Rows are dealt to tasks by ranges of the column, and within equal values by where they were
    read, so no value is too frequent for a task. They are written once, in order; the counts of the
    ranges, one a task, are summed up, and each row's number is its place in its range and the sum
    before. Rows with a null order come last; equal ones are numbered in any order. Own columns may
    have any names; one of the new name is replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() != into.lower()]
    keyed = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(order).alias("at"), F.monotonically_increasing_id().alias("read"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [F.col("at").asc_nulls_last(), F.col("read")]
    # The id's upper bits number the range, its lower 33 bits the rows within.
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("place"))
    placed = written(dealt, "numbered")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a task
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    found = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], number.cast("long").alias(into))


def pending(prompts: DataFrame, existing: DataFrame, refused: DataFrame, key: str = "prompt_id", limit: int | None = None) -> DataFrame:
    """Prompts without an answer or refusal. Ids are compared as strings; the limit counts what is left."""
    done = existing.select(F.col(key).cast("string").alias("_id")).union(refused.select(F.col(key).cast("string"))).distinct()
    left = prompts.join(done, prompts[key].cast("string") == done["_id"], "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def is_refused(refusal_detected: Column, status: Column, generation: Column) -> Column:
    """Whether a row counts as refused: so marked, failed, or without text. Never null."""
    return F.coalesce(refusal_detected, F.lit(False)) | F.coalesce(status == "failed", F.lit(False)) | (F.coalesce(generation, F.lit("")) == "")


def placeholders(refused: DataFrame, existing: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Rows that stand for refused prompts not yet in the log; an unknown id has an empty prompt."""
    new = refused.select(F.col(key).cast("string").alias("_id")).distinct().join(existing.select(F.col(key).cast("string").alias("_id")), "_id", "left_anti")
    known = prompts.select(F.col(key).cast("string").alias("_id"), "prompt")
    return new.join(known, "_id", "left").select(
        F.col("_id").cast("long").alias(key), F.coalesce("prompt", F.lit("")).alias("prompt"), F.lit(None).cast("string").alias("generation"), F.lit("skipped").alias("status"),
        F.lit("skipped -- prior refusal").alias("error"), F.lit(0.0).alias("duration_sec"), F.lit(0).cast("long").alias("tokens_generated_prompt"), F.lit(True).alias("refusal_detected"),
    )


def decided(rows: DataFrame, threshold: float = 0.8, enabled: bool = True) -> DataFrame:
    """``rows(generation, status, label, confidence)`` after the refusal decision: the text stays, the status fails, ``keep_pairs`` says whether pairs do."""
    hit = F.lit(enabled) & (strip(F.coalesce("generation", F.lit(""))) != "") & F.coalesce((F.lower(strip(F.col("label"))) == "refusal") & (F.col("confidence") >= threshold), F.lit(False))
    return rows.withColumn("refusal_detected", hit).withColumn("status", F.when(hit, F.lit("failed")).otherwise(F.col("status"))).withColumn("error", F.when(hit, F.lit("refusal detected"))).withColumn("keep_pairs", ~hit)


def classifier_input(user: Column, assistant: Column, most: int = 256, user_most: int = 100, user_least: int = 40) -> Column:
    """The text a refusal scorer reads: words of both sides, the user's cut first, so that all fits."""
    u, a = F.slice(F.split(user, " "), 1, user_most), F.split(assistant, " ")
    room = F.greatest(F.lit(user_least), F.least(F.size(u), F.lit(most) - F.size(a)))
    kept = F.slice(u, F.lit(1), F.greatest(room, F.lit(1)))
    rest = F.slice(a, F.lit(1), F.greatest(F.lit(most) - F.size(kept), F.lit(1)))
    return F.concat(F.lit("<|user|>\n"), F.array_join(kept, " "), F.lit("\n<|assistant|>\n"), F.array_join(rest, " "))


def joined(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, text``: the parts of each text in order, joined. Null parts add nothing; parts of one number are in the order of their texts. A text is one task's."""
    one = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["part"]), "").alias("text"))


def run_log(*parts: DataFrame) -> DataFrame:
    """All status rows as one log; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
