"""Throughput and profiling metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_throughput(timings: DataFrame, run: str = "run_id") -> DataFrame:
    """Timings with ``tokens_per_sec``: growth of the context over the time of the call; the first chunk counts from nothing."""
    before = F.coalesce(F.lag("ctx_len").over(Window.partitionBy(run).orderBy("chunk")), F.lit(0))
    return timings.withColumn("tokens_per_sec", F.when(F.col("api_sec") > 0, (F.col("ctx_len") - before) / F.when(F.col("api_sec") > 0, F.col("api_sec"))))


def bursts(events: DataFrame, key: str, burst_us: int, bucket_us: int) -> DataFrame:
    """``key, us, tokens``: events that follow within ``burst_us`` are one, at the time of the last.

    A gap starts an island. Islands are told within buckets of time, and bucket summaries carry an
    island on from one bucket to the next, so no task sees all events of a key.
    """
    timed = events.select(key, "us", "tokens", F.floor(F.col("us") / bucket_us).alias("_bucket"))
    inside = Window.partitionBy(key, "_bucket").orderBy("us")
    opened = timed.withColumn("_open", F.when(F.col("us") - F.lag("us").over(inside) <= burst_us, 0).otherwise(1))
    opened = opened.withColumn("_n", F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = Window.partitionBy(key).orderBy("_bucket")
    summary = opened.groupBy(key, "_bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("_n").alias("n"))
    summary = summary.withColumn("goes_on", F.coalesce(F.col("first") - F.lag("last").over(over) <= burst_us, F.lit(False)))
    # The island that a bucket's first events belong to: its own first, or the last of the nearest bucket before that has one of its own.
    own_last = F.when((F.col("n") > 1) | ~F.col("goes_on"), F.struct("_bucket", "n"))
    carried = F.last(own_last, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.select(key, "_bucket", F.when(F.col("goes_on"), carried).alias("_carried"))
    told = opened.join(summary, [key, "_bucket"])
    island = F.when((F.col("_n") == 1) & F.col("_carried").isNotNull(), F.col("_carried")).otherwise(F.struct(F.col("_bucket"), F.col("_n").alias("n")))
    return told.groupBy(key, island.alias("_island")).agg(F.max("us").alias("us"), F.sum("tokens").alias("tokens")).drop("_island")


def smoothed_rate(events: DataFrame, key: str, burst_us: int = 5_000, trailing_us: int = 5_000_000, entries: int = 160) -> DataFrame:
    """``key, us, tokens, rate`` of ``events(key, us, tokens)``.

    Events that follow within ``burst_us`` are one; the rate is the sum over the trailing window,
    of its last ``entries`` at most, divided by its span; null where that is no time. Buckets of
    time, each with what of the one before it is still in the window, share a key among tasks.
    """
    bucket_us = 12 * trailing_us
    merged = bursts(events, key, burst_us, bucket_us).withColumn("_bucket", F.floor(F.col("us") / bucket_us))
    late = merged.where(F.pmod("us", F.lit(bucket_us)) >= bucket_us - trailing_us).withColumn("_bucket", F.col("_bucket") + 1)
    both = merged.withColumn("_own", F.lit(True)).unionByName(late.withColumn("_own", F.lit(False)))
    back = Window.partitionBy(key, "_bucket").orderBy("us").rangeBetween(-trailing_us, 0)
    few = Window.partitionBy(key, "_bucket").orderBy("us").rowsBetween(1 - entries, 0)
    many = F.count("*").over(back) > entries
    span = (F.col("us") - F.when(many, F.min("us").over(few)).otherwise(F.min("us").over(back))) / 1e6
    total = F.when(many, F.sum("tokens").over(few)).otherwise(F.sum("tokens").over(back))
    rated = both.withColumn("_span", span).withColumn("_total", total).where("_own")
    return rated.select(key, "us", "tokens", F.when(F.col("_span") > 1e-6, F.col("_total") / F.when(F.col("_span") > 1e-6, F.col("_span"))).alias("rate"))


def run_totals(log: DataFrame, key: str) -> DataFrame:
    """Per run: prompts, tokens, seconds from first to last, tokens a second (0 if no time passed)."""
    out = log.groupBy(key).agg(F.count("*").alias("prompts"), F.sum("tokens").alias("tokens"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"))
    return out.withColumn("tokens_per_sec", F.when(F.col("seconds") > 0, F.col("tokens") / F.when(F.col("seconds") > 0, F.col("seconds"))).otherwise(0.0))


def zones(calls: DataFrame) -> DataFrame:
    """``label, seconds, calls, ms_per_call`` of ``calls(label, sec)``, the most expensive first."""
    out = calls.groupBy("label").agg(F.sum("sec").alias("seconds"), F.count("*").alias("calls"))
    return out.withColumn("ms_per_call", F.col("seconds") / F.col("calls") * 1000.0).orderBy(F.desc("seconds"), "label")
