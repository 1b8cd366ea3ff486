"""Language identification by Bayesian evidence fusion.

The posterior of a row's language is, up to a factor,

    P(language | host) * P(text | language) * P(declared | language) * P(suffix | language)

* Text: naive Bayes over hashed byte trigrams of the lower-case text, the whole text. One more
  class, ``und``, spreads its probability evenly, and thin enough that a text with some numbers
  or codes in it stays with its language: what is like no language at all falls to it.
* Declared language (``<html lang>`` or a column) and address suffix: how often texts of a
  language carry the value, counted over all rows in one grouped aggregation.
* Host: how often a host's texts are in a language, smoothed towards its domain, that towards
  its suffix, and that towards the whole corpus, each level a grouped aggregation.

Counts use the text evidence alone as label, so no evidence confirms itself. Only the trigram
table is fitted on a sample: of each label at most ``SAMPLE`` different texts, chosen by a hash.
Every label that some row declares is a language, however rare: what keeps noise down is that a
language's prior follows its counts over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.session import cut, slices

#: Different texts of one label that the trigram table is fitted on at most.
SAMPLE = 4000
#: Labels at most: a table of them all, 1 MB each, is in every task. A column with more does not name languages, which is an error.
MOST_LABELS = 256
#: Hash bins of trigrams; share of a language's probability that is spread over all of them; strength of the smoothing by the next level.
BINS, SPREAD, STRENGTH = 1 << 18, 0.1, 20.0
#: Over so many trigrams ``und`` spreads.
EVEN = 1 << 20
#: Trigrams overlap, so each counts for a third. ``HEARD``: a text's trigrams together count for so many independent ones at most
#: (the mean of all of them does, so no part of the text is left out), lest a long text drown all other evidence.
OVERLAP, HEARD = 3.0, 300.0
UNKNOWN = "und"
#: A row is rejected if its best language is ``und`` or has less than this posterior.
LEAST_POSTERIOR = 0.5


def trigrams(text: str) -> np.ndarray:
    """Hash bins of a text's byte trigrams, in order; white space at both ends counts."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(14)


class Model:
    """Log probabilities of trigram bins for each language, and for ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) if len(languages) else np.zeros((0, BINS))
        table = np.log((1.0 - SPREAD) * shares + SPREAD / BINS)
        self.table = np.concatenate([table, np.full((1, BINS), -np.log(EVEN))]).T.astype(np.float32).copy()

    def evidence(self, text: str, heard: float = HEARD) -> np.ndarray:
        """Log likelihood of the whole text in each language, less that of the best; as of ``heard`` independent trigrams at most."""
        t = trigrams(text)
        total = np.zeros(len(self.languages))
        for i in range(0, len(t), 1 << 16):
            total += self.table[t[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        n = max(1, len(t))
        total *= min(n / OVERLAP, heard) / n
        return total - total.max()


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The trigram table of ``labelled(id, text, label)``, from at most ``sample`` different texts of each label, chosen by a hash."""
    rows = labelled.where("text is not null and label is not null").select("label", "text", F.xxhash64("text").alias("h"))
    seen = cut(rows.groupBy("label").agg(F.approx_count_distinct("h").alias("texts")), "labels")
    if (found := seen.count()) > MOST_LABELS:
        raise ValueError(f"{found} labels; at most {MOST_LABELS} languages are told apart")
    known = F.broadcast(seen.select("label", F.least(F.lit(1.0), 2.0 * sample / F.col("texts")).alias("share")))  # one row a label
    drawn = rows.join(known, "label").where(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).dropDuplicates(["label", "h"])
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= sample).select("label", "text")

    def told(sums: dict[str, np.ndarray]) -> list[pa.Array]:
        bins = [np.flatnonzero(x).astype(np.int32) for x in sums.values()]
        return [pa.array(list(sums), pa.string()), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([x[b].tobytes() for b, x in zip(bins, sums.values(), strict=True)], pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bins, n = np.unique(trigrams(text), return_counts=True)
                sums.setdefault(label, np.zeros(BINS, np.int64))[bins] += n
        yield pa.RecordBatch.from_arrays(told(sums), ["label", "bins", "counts"])

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(BINS, np.int64)
        for bins, n in zip(group.column("bins").to_pylist(), group.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(bins, np.int32)] += np.frombuffer(n, np.int64)
        return pa.Table.from_arrays(told({group.column("label")[0].as_py(): total}), ["label", "bins", "counts"])

    schema = "label string, bins binary, counts binary"
    kept: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(count, schema).groupBy("label").applyInArrow(summed, schema).collect():  # the bins of one label a row, and few labels
        kept[r["label"]] = np.zeros(BINS, np.int64)
        kept[r["label"]][np.frombuffer(r["bins"], np.int32)] = np.frombuffer(r["counts"], np.int64)
    return Model(sorted(kept), np.array([kept[x] for x in sorted(kept)]).reshape(len(kept), BINS))


def levels(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain and suffix of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)


_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
#: What is not running text. Content that is no markup goes on to its end tag, or to the page's end; menus and footers end at the next such part
#: at the latest. Every stretch is read once, whatever is left open.
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|"
    + "|".join(rf"<{t}\b[^<]*+(?:<(?!/{t}\b)[^<]*+)*+(?:</{t}\b[^>]*+>|\z)" for t in ("script", "style", "title"))
    + "|"
    + "|".join(rf"<{t}\b[^<]*+(?:<(?!/{t}\b|(?:nav|footer|article|main|body)\b)[^<]*+)*+</{t}\b[^>]*+>" for t in ("nav", "footer"))
    + r"|<[^>]*+>"
)


def declared_markup(html: Column) -> Column:
    """The language that a page's ``html`` element declares, in lower case; null if none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), _LANG.pattern.replace("<html", "(?i)<html"), 1))
    return F.when(found != "", found)


def visible(html: Column) -> Column:
    """A page's text, roughly: scripts, styles, menus and markup left out."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")


def identify(rows: DataFrame, model: Model, least: float = LEAST_POSTERIOR, heard: float = HEARD) -> DataFrame:
    """``id, language, posterior, kept``, one row per row of ``rows(id, text, declared, host, domain, suffix)``.

    Null or empty texts have no text evidence: other evidence alone may name a language. Rows
    that repeat are counted and answered each. Missing evidence (null or empty) is left out. An
    empty table gives no rows. Ties go to the language first in order, ``und`` last. Texts are
    read whole, however long; ``heard`` bounds how much theirs outweighs the other evidence.
    Further columns are ignored.
    """
    n = len(model.languages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            found = [model.evidence(t or "", heard) for t in texts]
            best = [int(x.argmax()) if t and t.strip() else -1 for x, t in zip(found, texts, strict=True)]
            keep = [k for k, name in enumerate(b.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([x.tolist() for x in found], pa.list_(pa.float64())), pa.array(best, pa.int32())], [*(b.schema.names[k] for k in keep), "evidence", "best"])

    id_type = dict(rows.dtypes)["id"]
    narrow = rows.select("id", F.col("text").cast("string").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("declared", "host", "domain", "suffix")])
    read_rows = cut(narrow.mapInArrow(read, f"id {id_type}, declared string, host string, domain string, suffix string, evidence array<double>, best int"), "evidence")

    # One grouped pass over narrow rows; everything below is made from its sums.
    counts = read_rows.where("best >= 0").groupBy("host", "domain", "suffix", "declared", "best").agg(F.count("*").alias("n"))
    counts = cut(counts, "counts")
    per = lambda *keys: counts.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n)]).alias("c"))
    everything = per().first()
    total = np.array([x or 0.0 for x in everything["c"]]) if everything and everything["c"] else np.zeros(n)
    overall = (total + 1.0) / (total.sum() + n)

    def smoothed(own: Column, above: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    base = F.array(*[F.lit(float(x)) for x in overall])
    suffixes = per("suffix").select("suffix", smoothed(F.col("c"), base).alias("s_prior"))
    domains = per("suffix", "domain").join(suffixes, "suffix").select("suffix", "domain", smoothed(F.col("c"), F.col("s_prior")).alias("d_prior"))
    hosts = per("suffix", "domain", "host").join(domains, ["suffix", "domain"]).select("suffix", "domain", "host", smoothed(F.col("c"), F.col("d_prior")).alias("prior"))

    # P(value | language): the counts of a value, smoothed by its share in the whole corpus.
    totals = F.array(*[F.lit(float(x)) for x in total])

    def given(column: str) -> DataFrame:
        share = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.lit(float(max(1.0, total.sum())))
        return per(column).where(F.col(column) != "").select(column, F.zip_with("c", totals, lambda c, t: F.log((c + STRENGTH * share) / (t + STRENGTH))).alias(f"{column}_evidence"))

    zero = F.array(*[F.lit(0.0)] * n)
    keyed = read_rows.join(hosts, ["suffix", "domain", "host"], "left").join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scores = add(add("evidence", F.transform(F.coalesce("prior", base), lambda p: F.log(p))), add(F.coalesce("declared_evidence", zero), F.coalesce("suffix_evidence", zero)))
    top = F.array_max("scores")
    names = F.array(*[F.lit(x) for x in model.languages])
    scored = keyed.select("id", scores.alias("scores")).select(
        "id",
        F.element_at(names, F.array_position("scores", top).cast("int")).alias("language"),
        (1.0 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("posterior"),
    )
    return scored.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least))


def of_documents(docs: DataFrame) -> DataFrame:
    """``identify`` for documents: the declared language is ``lang``, the host is ``source``; ids are ``doc_id``."""
    model = fit(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")))
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))
    return identify(rows, model).withColumnRenamed("id", "doc_id")


def of_pages(pages: DataFrame) -> DataFrame:
    """``identify`` for web pages, with markup and address as evidence; ids are ``page_id``."""
    declared = declared_markup(F.col("html"))
    host, domain, suffix = levels(F.col("url"))
    rows = pages.select(F.col("page_id").alias("id"), visible(F.col("html")).alias("text"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    return identify(rows, fit(rows.select("id", "text", F.col("declared").alias("label")))).withColumnRenamed("id", "page_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns.

    Rejected rows are told by a hash of their columns. They are written out before they are
    joined, so the planner knows their size when it chooses whether to broadcast them.
    """
    key = F.xxhash64("doc_id", "text", "source", "lang")
    found = of_documents(docs.select(key.alias("doc_id"), "text", "source", "lang"))
    rejected = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias("_row")).distinct(), "rejected")
    left = docs.select(F.struct("*").alias("_doc"), key.alias("_row")).join(rejected, "_row", "left_anti")
    return left.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
