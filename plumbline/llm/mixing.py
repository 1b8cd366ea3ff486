"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its share, by weight, of ``share`` times all
words, but never more than ``cap`` times its own words; what a full source cannot take is
shared again by weight among the others. A document's expected copies are its source's
target over its source's words. Within a source, documents lie in a fixed order, the prefix
sum of expected copies runs over them, one offset is added, and a document is emitted once
for each integer that its step crosses. So a document gets the floor or the ceiling of its
expectation, and the order by size keeps the words taken near the target.

The prefix sum is built from blocks (source, size class, salt): ranks within a block, block
counts within a size class, class counts within a source. No task sees more of a hot source
than one block, and the two upper levels hold at most 256 and a few hundred rows a key. The salt
comes from doc_id and text, so one doc_id may have any number of rows; rows that are the same in
both are one row with a number until the end, when many tasks list them. Targets are worked out
from one row a source, in one task: sources are taken to be few, some millions at most.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.session import cut, partitions

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """One narrow row per document: its size, its place in the order of its source, and a hash of what ``more`` columns hold."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    bits = F.length(F.bin("size"))
    also = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in more]) if more else F.lit(0).cast("long")
    return (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text", "source").alias("row_key"), word_count(F.col("text")).alias("size"), h.alias("h"), also.alias("also"))
        .withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .withColumn("class", bits * 16 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0))))
        .withColumn("salt", F.substring("h", 1, 2))
    )


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Source key, size, target and rate of each source.

    The level is where min(weight * level, cap * size) adds up to the mix: sources are put in
    the order in which they fill up, and the level is the first that leaves its source unfilled.
    One row per source; the windows run over that table only.
    """
    every = Window.partitionBy(F.lit(0))
    sources = rows.groupBy("sk", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    full = Window.partitionBy(F.lit(0)).orderBy("fills_at", "position")
    levelled = (
        sources.withColumn("position", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("mix", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("filled", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("mix") - F.col("filled")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "position", "level"))).over(every)["level"])
    )
    target = F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("most")), F.col("most"))
    return levelled.select("sk", "source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def offset(seed: int, sk: Column) -> Column:
    """The offset of a source, a multiple of 2**-16 in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), sk).cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0


#: Equal rows that one row stands for until they are listed.
LISTED = 65_536


def _placed(docs: DataFrame, more: Sequence[str], weights: Sequence[float], share: float, cap: float, seed: int) -> tuple[DataFrame, int]:
    """One row for all equal ones, with their number ``n``, and ``start``: how many rows of their source come before. And the largest number."""
    rows = sized(docs, *more)
    rows = cut(rows.groupBy("doc_id", "row_key", "also", "source", "sk", "size", "h", "class", "salt").agg(F.count("*").alias("n")), "sized")
    keys = ["sk", "class", "salt"]
    before = lambda of, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("in_class", before(["sk", "class"], "salt"))
    classes = rows.groupBy("sk", "class").agg(F.sum("n").alias("n")).withColumn("in_source", before(["sk"], "class")).drop("n")
    rates = targets(rows, weights, share, cap).drop("source")
    starts = blocks.join(classes, ["sk", "class"]).join(rates, "sk").select(*keys, (F.col("in_class") + F.col("in_source")).alias("block_start"), "source_size", "target", "rate")
    ranked = rows.withColumn("in_block", before(keys, "size", "h", "doc_id", "row_key", "also"))
    placed = ranked.join(starts, keys).withColumn("start", F.col("block_start") + F.col("in_block"))
    return placed.withColumn("u", offset(seed, F.col("sk"))), rows.agg(F.max("n")).first()[0] or 0


def _copies(at: Column) -> Column:
    """How often the row of this rank (from 1) in its source is taken."""
    crossed = F.floor(F.col("u") + F.col("rate") * at) - F.floor(F.col("u") + F.col("rate") * (at - 1))
    return F.greatest(F.floor("rate"), F.least(crossed, F.ceil("rate"))).cast("long")


def _each(placed: DataFrame, most: int) -> DataFrame:
    """``placed`` with a row for each of ``n``, and its ``rank``. Large numbers are dealt to many tasks."""
    if most <= 1:
        return placed.withColumn("rank", F.col("start") + 1)
    if most > LISTED:
        firsts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(LISTED).cast("long"))
        parted = placed.withColumn("_first", F.explode(firsts)).withColumn("start", F.col("start") + F.col("_first")).withColumn("n", F.least(F.lit(LISTED).cast("long"), F.col("n") - F.col("_first"))).drop("_first")
        placed = parted.repartition(partitions(placed.sparkSession))
    return placed.withColumn("rank", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """``doc_id, row_key, size, source_size, target, copies, taken``: one row per input row.

    Null texts and texts of white space have size 0; the null source is a source of its own,
    last in the order. Copies of a row, and rows that share a doc_id, are rows like any other.
    An empty table gives no rows; columns other than doc_id, source and text are ignored.
    Equal inputs give equal results in any partitioning. Long texts are only counted and hashed.
    """
    rows = _each(*_placed(docs, (), weights, share, cap, seed)).withColumn("copies", _copies(F.col("rank")))
    return rows.select("doc_id", "row_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with its own columns.

    Rows that agree in doc_id, source and text are told apart by their other columns; rows that
    agree in all are one row with a number. Own columns may have any names.
    """
    more = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "source")]
    placed, most = _placed(docs, more, weights, share, cap, seed)
    taken = _each(placed, most).withColumn("copies", _copies(F.col("rank"))).groupBy("row_key", "also").agg(F.sum("copies").alias("_times"), F.count("*").alias("_n")).where("_times > 0")
    also = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in more]) if more else F.lit(0).cast("long")
    keyed = docs.select(F.struct("*").alias("_doc"), F.xxhash64("doc_id", "text", F.col("source").cast("string")).alias("row_key"), also.alias("also"))
    found = keyed.join(taken, ["row_key", "also"])
    if most > 1:
        found = found.where("_n = 1").unionByName(found.where("_n > 1").dropDuplicates(["row_key", "also"]))
        steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / LISTED))
        found = found.withColumn("_part", F.explode(steps)).withColumn("_times", F.least(F.lit(LISTED).cast("long"), F.col("_times") - F.col("_part") * LISTED)).repartition(partitions(docs.sparkSession))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
