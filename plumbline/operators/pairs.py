"""Preference pairs: what was rejected, and what was chosen in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(decisions: DataFrame) -> DataFrame:
    """The pair records of ``decisions(prompt, generation, context, rejected, chosen, tail, kind, rule, n)``; those with an empty tail make none."""
    subtype = F.when(F.col("kind") == "ngram", F.when(F.col("n") == 3, F.lit("trigram")).otherwise(F.lit("bigram"))).otherwise(F.col("kind"))
    return decisions.where(F.size("tail") > 0).select(
        F.col("prompt").alias("prompt_raw"), F.col("generation").alias("generation_raw"), F.col("context").alias("context_with_chat_template"),
        F.col("chosen").alias("chosen_decoded"), F.col("rejected").alias("rejected_decoded"), F.col("chosen").alias("chosen_raw"), F.col("rejected").alias("rejected_raw"),
        F.col("tail").alias("multi_chosen_decoded"), F.col("tail").alias("multi_chosen_raw"), F.array("rejected").alias("multi_rejected_decoded"), F.array("rejected").alias("multi_rejected_raw"),
        F.struct(F.col("kind").alias("class"), F.col("rule").alias("rule"), subtype.alias("subtype")).alias("validator"), F.create_map().cast("map<string,string>").alias("stats"),
    )


def last_per_context(rows: DataFrame, sequence: str, context: str = "context_with_chat_template") -> DataFrame:
    """One pair for each context: the one captured last."""
    columns = [c for c in rows.columns if c != sequence]
    return rows.groupBy(context).agg(F.max_by(F.struct(*columns), F.col(sequence)).alias("x")).select("x.*")
