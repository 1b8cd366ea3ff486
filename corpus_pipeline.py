"""The training-data pipeline over documents: five stages, each written and read again.

1. language ID: documents in no known language go.
2. near-dedup: of each group of near duplicates, the document of the least id stays (links of
   SimHashes of five-word shingles, and bands beside them; four fifths of the shingles are common
   in each link).
3. secret scan: what looks like a secret is replaced by a mark, and ``n_chars`` follows.
4. mixing: each document as often as the mix takes it, from none to two times.
5. byte-level BPE: the ids of each text and their bytes, as digests.

Null texts are empty and stay (the first of them, as near duplicates of each other); rows that
repeat are near duplicates; a null doc_id comes last; own columns are carried through all stages
but the last, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, mixing, secret_scan, similar
from plumbline.llm.queries import bpe_digests
from plumbline.llm.session import cut, dropped, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return language_id.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similar.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets marked out."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_dedup", near_dedup),
    ("secret_scan", secrets),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Neither language models nor byte-pair merges can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        dropped(*written)  # a stage's table goes once the next one is written
        written = [docs]
    return docs
