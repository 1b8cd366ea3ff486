"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits have a point in common in the balls of radius r around them.
So every fingerprint emits all variants within r = 2 bits of it, equal variants meet, and the
colliding pairs are verified and made into components.

A 64-bit fingerprint has 2,081 such variants. They are dealt by their leading bits, and those
that go to one bucket need not be listed on the way: a bucket is sent each fingerprint that has
some variant there, once, and lists the variants on arrival. With k leading bits that is
1 + k + k(k-1)/2 rows a fingerprint instead of 2,081. k grows with the number of distinct
fingerprints, so buckets stay as they are in size; buckets that near copies crowd are split by
further bits until they are small too. Equal fingerprints are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.session import cut, slices

BITS, RADIUS = 64, 2
#: Variants in a bucket, about; fingerprints in a bucket before it is split; bits of a split.
BUCKET_VARIANTS, CROWDED, STEP = 4_000_000, 100_000, 4
#: Variants that a task lists at once.
AT_ONCE = 3_000_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[last:], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, row_key, fp``: the fingerprint as a signed 64-bit integer, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key long, fp long")


def row_key() -> Column:
    """What tells rows apart; equal rows are interchangeable."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key")


def masks(bits: int, radius: int) -> list[int]:
    """All numbers of so many bits with at most ``radius`` ones."""
    return [sum(1 << b for b in on) for r in range(radius + 1) for on in combinations(range(bits), r)]


def _leading(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - bits) if bits else F.lit(0).cast("long")


def routed(classes: DataFrame, bits: int) -> DataFrame:
    """``bits, bucket, fp``: every fingerprint in each bucket that holds a variant of it, crowded buckets split."""
    spread = lambda df, own, step: df.withColumn("bucket", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks(step, RADIUS)]), lambda m: own.bitwiseXOR(m))))
    level = spread(classes.select("fp"), _leading(F.col("fp"), bits), bits)
    done = None
    while True:
        level = level.withColumn("bits", F.lit(bits))
        crowded = level.groupBy("bucket").count().where(F.col("count") > CROWDED).select("bucket")
        if bits + STEP > BITS or crowded.isEmpty():
            return level if done is None else done.unionByName(level)
        crowded = cut(crowded, "crowded")
        calm = level.join(crowded, "bucket", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        full = level.join(crowded, "bucket", "left_semi").drop("bits").withColumnRenamed("bucket", "upper")
        bits += STEP
        own = F.shiftleft("upper", STEP).bitwiseOR(_leading(F.col("fp"), bits).bitwiseAND(F.lit((1 << STEP) - 1).cast("long")))
        level = cut(spread(full, own, STEP).where(F.bit_count(F.col("bucket").bitwiseXOR(_leading(F.col("fp"), bits))) <= RADIUS).drop("upper"), "split")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


_low: dict[tuple[int, int], np.ndarray] = {}


def _low_masks(bits: int, radius: int) -> np.ndarray:
    if (bits, radius) not in _low:
        _low[bits, radius] = np.array(masks(bits, radius), np.uint64)
    return _low[bits, radius]


def collisions(fps: np.ndarray, bucket: int, bits: int) -> Iterator[np.ndarray]:
    """Index pairs of fingerprints that have a variant in common in the bucket of these leading bits."""
    if len(fps) < 2:
        return
    rest = BITS - bits
    lead = fps >> np.uint64(rest) if bits else np.zeros_like(fps)
    away = _popcount(lead ^ np.uint64(bucket))
    each = [len(_low_masks(rest, RADIUS - d)) for d in range(RADIUS + 1)]
    if sum(int((away == d).sum()) * each[d] for d in range(RADIUS + 1)) > AT_ONCE and rest > 1:
        for bit in (0, 1):
            next_bucket = 2 * bucket + bit
            near = np.flatnonzero(_popcount((fps >> np.uint64(rest - 1)) ^ np.uint64(next_bucket)) <= RADIUS)
            for pairs in collisions(fps[near], next_bucket, bits + 1):
                yield near[pairs]
        return
    low = np.uint64((1 << rest) - 1)
    values, owners = [], []
    for d in range(RADIUS + 1):
        at = np.flatnonzero(away == d)
        if len(at):
            flips = _low_masks(rest, RADIUS - d)
            values.append(((fps[at] & low)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(at, len(flips)))
    if not values:
        return
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    yield np.stack([owner[same], owner[same + 1]], axis=1)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs enough to connect what the given pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def links(classes: DataFrame, distance: int = 2 * RADIUS) -> DataFrame:
    """``a, b``: verified pairs of distinct fingerprints within ``distance`` bits, enough of them to connect all that link.

    Within a bucket, pairs that others already connect are left out.
    """
    n = classes.count()
    bits = max(0, (n * len(masks(BITS, RADIUS)) // BUCKET_VARIANTS).bit_length())

    def meet(key, group):
        depth, bucket = key[0].as_py(), key[1].as_py()
        fps = np.unique(group.column("fp").combine_chunks().to_numpy().view(np.uint64))
        found = []
        for pairs in collisions(fps, bucket, depth):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (_popcount(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= distance)]
            if len(pairs):
                found.append(pairs)
        kept = np.array(forest(np.concatenate(found)) if found else [], np.int64).reshape(-1, 2)
        return pa.table({"a": fps[kept[:, 0]].view(np.int64), "b": fps[kept[:, 1]].view(np.int64)})

    return routed(classes, bits).groupBy("bits", "bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, row_key, fp, root, component_id``: the least doc_id that links of 4 bits or fewer reach, one row per row of ``docs``.

    Null texts have no words, as empty ones: fingerprint 0, linked like any other. Rows that
    repeat are in one class. A null doc_id takes part, but names a component only where it has
    no other. An empty table gives no rows; further columns are ignored.
    """
    prints = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, width: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id. Null ids come last."""
    return one_of_each(docs, near_duplicates(docs, width))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of ``grouped(row_key, root, doc_id)``."""
    near = cut(grouped.select("row_key", "root", "doc_id"), "near")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    winners = near.groupBy("root").agg(F.min(place)["row_key"].alias("row_key"))
    losers = cut(near.select("row_key", "root").distinct().join(winners, ["root", "row_key"], "left_anti").select("row_key"), "losers")
    keyed = docs.select(F.struct("*").alias("_doc"), row_key())
    left = keyed.join(losers, "row_key", "left_anti")
    repeated = cut(near.groupBy("row_key").count().where("count > 1").select("row_key"), "repeated")
    if not repeated.isEmpty():
        left = left.join(repeated, "row_key", "left_anti").unionByName(left.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
