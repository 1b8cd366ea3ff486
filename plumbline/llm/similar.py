"""Near duplicates: SimHash links, completed by bands of minima, every link compared shingle by shingle.

A text's shingles are five words each (all of its words, if it has fewer), without repeats. Texts
are near when at least four fifths of the shingles of both are common. Candidates come from

1. the ball hashing of ``simhash``, over the SimHashes of these shingles: pairs within 4 bits;
2. since a SimHash of 64 bits tells no more (pairs at 0.87 may differ in 9 bits), 40 bands of 5
   minima of the shingles' hashes. A pair at 0.8 has no band in common with a probability of
   (1 - 0.8^5)^40 = 1.3e-7, a nearer one with less.

Groups are found in two steps. First each text of a band is compared with one of them, another in
each band, and in further rounds, where a band still holds several components, one text of each with
another centre: work in proportion to the rows of all bands, which ties most of what copies fill a
band with. Then all texts of a band that are not yet in one group are compared with each other, as
pairs in bands of up to ``FEW_SETS`` sets and block against block, within a task, in larger ones. So
every two texts with a band in common are compared or in one group, and what the SimHashes' links
leave out (they only connect) is found by the bands. That step is in proportion to the square of a
band of texts that are alike and yet not near, by nature; a task holds two blocks of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.session import cut, dropped, slices
from plumbline.llm.simhash import forest, one_of_each, row_key
from plumbline.llm.simhash import links as simhash_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
#: Rounds of comparing a band's texts with one of them.
ROUNDS = 3
#: Sets of a band that are compared as pairs; sets in a block of a larger band; shingles that are counted at once.
FEW_SETS, BLOCK_SETS, COUNTED = 16, 256, 2048
#: Shingles whose hashes are spread at once.
AT_ONCE = 1024
#: The session's setting of rows in a batch, and rows in a batch of pairs.
BATCH, FEW = "spark.sql.execution.arrow.maxRecordsPerBatch", 512

_random = np.random.default_rng(9)
_times = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_flips = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's word shingles, in order, each once; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[last:], strict=False)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band of minima."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), AT_ONCE):
        x = (low[i : i + AT_ONCE, None] ^ _flips) * _times
        np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the shingles of both that are common; two texts without words are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def simhash_of(found: np.ndarray) -> np.uint64:
    """The SimHash of a set of shingles."""
    ones = np.unpackbits(found.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).view(">u8")[0]


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, same, size, fp, bands``: ``same`` is one number for each set of shingles, ``size`` its shingles, ``fp`` its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
            fps = np.array([simhash_of(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), keys], ["doc_id", "row_key", "same", "size", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key long, same long, size int, fp long, bands array<long>")


def near(pairs: DataFrame, bodies: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingles are so alike; ``bodies(same, size, body)`` has the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            kept = pa.array([likeness(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(kept)

    sizes = bodies.select("same", "size")
    # Sets of too different sizes cannot be so alike; told without reading them.
    even = pairs.join(sizes.toDF("a", "m"), "a").join(sizes.toDF("b", "n"), "b").where(F.least("m", "n") >= F.greatest("m", "n") * least - 1e-6).select("a", "b")
    full = even.join(bodies.select(F.col("same").alias("a"), F.col("body").alias("x")), "a").join(bodies.select(F.col("same").alias("b"), F.col("body").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``near``, written out; in batches of few rows, since each holds the shingles of two texts."""
    conf = pairs.sparkSession.conf
    old = conf.get(BATCH)
    conf.set(BATCH, str(min(FEW, int(old)) if int(old) > 0 else FEW))
    try:
        return cut(near(pairs, bodies), "links")
    finally:
        conf.set(BATCH, old)


def by_simhash(prints: DataFrame) -> DataFrame:
    """``a, b``: sets of shingles whose SimHashes are the same or within 4 bits, enough of them to connect all such; the others are compared in their bands (``untied``)."""
    classes = cut(prints.select("same", "fp").distinct(), "classes")
    least = cut(classes.groupBy("fp").agg(F.min("same").alias("rep")), "least")
    equal = classes.join(least, "fp").where("same <> rep").select(F.col("rep").alias("a"), F.col("same").alias("b"))
    near_by = simhash_links(least.select("fp")).toDF("x", "y")
    named = near_by.join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select("a", "b")
    return equal.unionByName(named)


def stars(rooted: DataFrame, turn: int) -> DataFrame:
    """``a, b``: one set of each root of ``rooted(band, same, root)`` in each band, with one set of the whole band, which ``turn`` changes."""
    drawn = F.struct(F.xxhash64("band", "same", F.lit(turn)).alias("h"), "same")
    each = rooted.groupBy("band", "root").agg(F.min(drawn).alias("rep"))
    centre = each.groupBy("band").agg(F.min(F.struct("rep", "root")).alias("c"), F.count("*").alias("n")).where("n > 1").select("band", "c")
    met = each.join(centre, "band").where(F.col("root") != F.col("c.root"))
    return met.select(F.least("rep.same", "c.rep.same").alias("a"), F.greatest("rep.same", "c.rep.same").alias("b"))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common. Those of one set only are not counted, so none with itself."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[at] > 1
    owner, at = owner[several], (np.cumsum(times > 1) - 1)[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    found = np.zeros((len(sets), len(sets)))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COUNTED):
        here = slice(*np.searchsorted(at, [first, first + COUNTED]))
        held = np.zeros((len(sets), COUNTED), np.float32)
        held[owner[here], at[here] - first] = 1
        found += held @ held.T
    return found


def tied(blocks: DataFrame, least: float = LEAST) -> DataFrame:
    """``a, b``: roots that a near pair ties, enough to connect all such, of ``blocks(band, i, j, block, root, body)``: each set of block i with each of j."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("body").to_pylist()]
        root, block, size = group.column("root").to_numpy(), group.column("block").to_numpy(), np.array([len(s) for s in sets], np.int64)
        both = common(sets)
        near = both / (size[:, None] + size[None, :] - both) >= least
        near &= root[:, None] < root[None, :]
        if key[1] != key[2]:
            near &= block[:, None] != block[None, :]
        x, y = np.nonzero(near)
        kept = np.array(forest(np.unique(np.stack([root[x], root[y]], axis=1), axis=0)), np.int64).reshape(-1, 2)
        return pa.table({"a": kept[:, 0], "b": kept[:, 1]})

    return blocks.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def untied(shared: DataFrame, roots: DataFrame, tested: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: what ties groups of ``roots`` by near pairs of ``shared(band, same)``: every two sets of a band and of different groups are compared, but those of ``tested``."""
    rooted = shared.join(roots, shared["same"] == roots["node"], "left").select("band", "same", F.coalesce("root", "same").alias("root"))
    several = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("band", "n")
    left = cut(rooted.join(several, "band"), "untied")
    few = left.where(F.col("n") <= FEW_SETS)
    other = few.select("band", F.col("same").alias("b"), F.col("root").alias("other"))
    pairs = cut(few.withColumnRenamed("same", "a").join(other, "band").where("a < b and root <> other").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    found = compared(pairs, bodies)
    parts = F.ceil(F.col("n") / BLOCK_SETS).cast("int")
    many = left.where(F.col("n") > FEW_SETS).withColumn("block", F.pmod(F.xxhash64("same"), parts).cast("int"))
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    blocks = many.join(bodies, "same").select("band", "block", "root", "body", F.inline(met))
    more = cut(tied(blocks), "links")
    dropped(left, pairs)
    return found.unionByName(more)


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, root``: rows of one root are linked by near pairs, one row per row of ``docs``.

    Null texts have no words, as empty ones; all of those are one group.
    """
    prints = cut(sketches(docs), "sketches")
    told = cut(prints.select("same", F.explode("bands").alias("band")).distinct(), "bands")
    full = told.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = cut(told.join(full, "band").select("band", "same"), "shared")
    dropped(told)
    tested = cut(by_simhash(prints).unionByName(stars(shared.withColumn("root", F.col("same")), 0)).distinct(), "pairs")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["same", "size", "body"])

    # One row stands for all of one set; equal rows have equal keys.
    # They are written out first, so the planner knows their size and need not deal all texts.
    needed = shared.select("same").union(tested.select("a")).union(tested.select("b")).distinct()
    standing = cut(prints.join(needed, "same").groupBy("same").agg(F.min("row_key").alias("row_key")), "standing")
    texts = docs.select(row_key(), F.col("text").cast("string").alias("text")).join(standing, "row_key").select("same", "text")
    bodies = texts.mapInArrow(body, "same long, size int, body binary")
    if not prints.join(standing, "row_key").groupBy("row_key").count().where("count > 1").isEmpty():
        bodies = bodies.dropDuplicates(["same"])
    bodies = cut(bodies, "bodies")

    links = compared(tested, bodies)
    for turn in range(1, ROUNDS):
        roots = cut(components(links), "roots")
        rooted = shared.join(roots, shared["same"] == roots["node"], "left").select("band", "same", F.coalesce("root", "same").alias("root"))
        new = cut(stars(rooted, turn).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        links, tested = cut(links.unionByName(compared(new, bodies)), "links"), cut(tested.unionByName(new), "pairs")
    found = cut(components(links), "roots")
    more = untied(shared, found, tested, bodies)
    dropped(shared, tested, bodies)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    return prints.join(found, prints["same"] == found["node"], "left").select("doc_id", "row_key", F.coalesce("root", "same").alias("root"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id. Null ids come last."""
    return one_of_each(docs, groups(docs))
