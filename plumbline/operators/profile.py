"""Corpus frequency analysis against a human profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import per_100k, ratio
from plumbline.functions.text import STOPWORDS, ngrams, words


def term_counts(docs: DataFrame, n: int, text: str = "text", least: int = 4, stopwords: tuple[str, ...] = tuple(STOPWORDS)) -> DataFrame:
    """``term, count`` of the n-grams within each text. Counted map-side before the one shuffle."""
    terms = docs.select(words(F.col(text), least, stopwords).alias("w")).select(F.explode(ngrams(F.col("w"), n)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("count"))


def total_chars(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, ``chars``: the characters of all raw texts."""
    return docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("chars"))


def top_terms(docs: DataFrame, n: int, k: int, text: str = "text") -> DataFrame:
    """``term, gen_count, gen_freq_per_100k`` of the k most frequent; ties by term."""
    top = term_counts(docs, n, text).orderBy(F.desc("count"), "term").limit(k)
    # The one-row side is broadcast: its size is one row whatever the input.
    return top.join(F.broadcast(total_chars(docs, text))).select("term", F.col("count").alias("gen_count"), per_100k(F.col("count"), F.col("chars")).alias("gen_freq_per_100k"))


def compared(gen: DataFrame, human: DataFrame, human_chars: DataFrame) -> DataFrame:
    """``gen`` with the human counts beside it: null ``human_count`` where the profile lacks the term."""
    own = [c for c in gen.columns if c not in ("term", "human_count", "human_freq_per_100k", "freq_ratio_gen_hu")]
    rows = gen.select("term", F.struct(*[F.col(c) for c in own]).alias("row"))
    joined = rows.join(human.select("term", F.col("count").alias("human_count")), "term", "left").join(F.broadcast(human_chars.select(F.struct("chars").alias("whole"))))
    freq = per_100k(F.coalesce("human_count", F.lit(0)), F.col("whole.chars"))
    found = joined.select("term", *[F.col("row")[c].alias(c) for c in own], "human_count", freq.alias("human_freq_per_100k"))
    return found.withColumn("freq_ratio_gen_hu", ratio(F.col("gen_freq_per_100k"), F.col("human_freq_per_100k")))


def matched(both: DataFrame) -> DataFrame:
    """Terms of the human profile, the most overused first."""
    return both.where("human_count is not null").orderBy(F.desc("freq_ratio_gen_hu"), "term")


def gen_only(both: DataFrame) -> DataFrame:
    """Terms that the human profile lacks, in the order of their counts."""
    none = both.where("human_count is null")
    return none.withColumn("human_count", F.lit(0).cast("long")).withColumn("human_freq_per_100k", F.lit(0.0)).withColumn("freq_ratio_gen_hu", F.lit(float("inf"))).orderBy(F.desc("gen_count"), "term")


def normalized_profile(items: DataFrame, n: int) -> DataFrame:
    """``term, count`` of profile items ``ngram, frequency``: as words, those of n words only, equal ones summed."""
    w = words(F.col("ngram"))
    kept = items.where("ngram is not null and frequency is not null").where(F.size(w) == n)
    return kept.groupBy(F.array_join(w, " ").alias("term")).agg(F.sum("frequency").alias("count"))


def refined(both: DataFrame, known: DataFrame, most: int, least_ratio: float) -> DataFrame:
    """The next terms to ban: the most overused that are not banned yet."""
    over = both.where(F.col("freq_ratio_gen_hu") >= least_ratio).join(known.select("term"), "term", "left_anti")
    return over.orderBy(F.desc("freq_ratio_gen_hu"), F.desc("gen_count"), "term").limit(most).select("term", "gen_count", "freq_ratio_gen_hu")


def diversity(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: words, different words and their share."""
    counts = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("words"), F.count("*").alias("types"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).withColumn("type_token_ratio", F.col("types") / F.col("words"))
