"""Removal of long repeats through run-length compressed Burrows-Wheeler indexes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere.

1. Anchors. Of each window of ``LENGTH`` bytes, the substring of ``GRAM`` bytes with the least
   hash (the first, if tied) is the anchor. Equal windows have equal anchors in equal places, so
   only windows whose anchor occurs twice can repeat. The windows of one anchor, which are
   neighbours, make up its context: all their bytes.
2. Index. Contexts are dealt by anchor, each different one once, with its number of copies, as a
   dictionary of a prefix-free parse: neighbouring contexts overlap by ``LENGTH - 1`` bytes, so
   each position of a text is one suffix of one context. The suffixes of a bucket are sorted;
   the byte before each, in that order, is the bucket's Burrows-Wheeler transform; copies lie
   together in it. It is kept as runs, with the positions sampled at both ends of each run and
   the length that each sample has in common with its neighbour outside.
3. Matching statistics stream over each context: within a run a match only grows to the left,
   so the statistic at a position is the furthest reach of the samples up to it, less the
   position. Where it is ``LENGTH`` or more, a repeat starts.
4. The repeats go back to all copies of a context, and the bytes that they cover are removed.

An anchor with many different contexts is dealt in parts: equal windows have the anchor in the
same place, so windows are dealt by that place, some places together, and if there are too many
windows with the anchor in one place, by a hash of the window too. Every part is indexed in the
same way, and no part holds much more than ``AT_ONCE`` suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import cut, dropped, slices

LENGTH, GRAM = 200, 48
SPAN = LENGTH - GRAM + 1
#: Bytes of a context at most; suffixes that a task sorts at once, about.
LONGEST, AT_ONCE = LENGTH + SPAN, 40_000

_BASE = 0x9E3779B97F4A7C15
_CODE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(max(n, 1 << 16), _BASE, np.uint64), np.full(max(n, 1 << 16), pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` bytes: differences of prefix sums, mixed."""
    up, down = _power_table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up, out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    n = len(values)
    v = np.concatenate([values, np.full(-n % span, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, span)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - span + 1], left[span - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each context of a text of ``LENGTH`` bytes or more."""
    h = gram_hashes(data)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_least(ranked, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]], first, np.concatenate([first[1:], [len(place)]]) - 1


def repeated_starts(contexts: list[bytes], copies: np.ndarray) -> list[np.ndarray]:
    """For each context, the windows that occur elsewhere: in another context, again in it, or in a copy of it."""
    lengths = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.frombuffer(b"".join(contexts) + bytes(LONGEST), np.uint8)
    windows = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    first = np.cumsum(windows) - windows
    offset = np.arange(len(owner)) - first[owner]
    at, rest = begin[owner] + offset, lengths[owner] - offset

    # The suffixes, cut at the end of their context, in order.
    rows = np.lib.stride_tricks.sliding_window_view(text, LONGEST)[at]
    rows[np.arange(LONGEST)[None, :] >= rest[:, None]] = 0
    order = np.argsort(rows.view(f"V{LONGEST}").ravel(), kind="stable")

    # The transform, as runs: a context's first suffix has nothing before it, and is a run of its own.
    before = np.where(offset > 0, text[at - 1].astype(np.int64), -1 - owner)[order]
    breaks = before[1:] != before[:-1]
    # Neighbours in a run also are neighbours one byte to the left, unless a suffix lies between them there whose own
    # right neighbour is too short to be a row here. Then the run is cut, so that the statistics reach on from samples alone.
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parted = np.zeros(len(breaks), bool)
    k = np.flatnonzero(~breaks)
    parted[k] = rank[order[k + 1] - 1] != rank[order[k] - 1] + 1
    joint = np.flatnonzero(breaks | parted)

    # Samples at the ends of runs: what each has in common with its neighbour across the break.
    a, b = order[joint], order[joint + 1]
    reach = np.zeros(len(owner), np.int64)
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192], b[i : i + 8192]
        differs = rows[x] != rows[y]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), LONGEST)
        common = np.minimum(common, np.minimum(rest[x], rest[y]))
        np.maximum.at(reach, x, common)
        np.maximum.at(reach, y, common)
    # Copies of a context lie next to it, and part at its beginning.
    copied = first[copies > 1]
    reach[copied] = np.maximum(reach[copied], rest[copied])

    # Matching statistics: the furthest end that a sample up to here reaches. Contexts follow one another, each beyond the last one's reach.
    far = np.where(reach > 0, at + reach, 0)
    statistic = np.minimum(np.maximum.accumulate(far) - at, rest)
    starts = statistic >= LENGTH
    return [np.flatnonzero(starts[f : f + w]) for f, w in zip(first.tolist(), windows.tolist(), strict=True)]


def intervals(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of numbers."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [len(starts) - 1]])].tolist()


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key")


def occurrences(docs: DataFrame) -> DataFrame:
    """``gram, ctx, row_key, place``: every anchor of every text. ``place``: first window * 256 + windows after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, ctx, keys, places = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                gram, first, last = anchors(np.frombuffer(data, np.uint8))
                grams.append(gram)
                digest = xxhash.xxh64_digest
                ctx.append(b"".join([digest(data[x:y], 7) for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]))
                keys.append(np.full(len(gram), key, np.int64))
                places.append(first * 256 + (last - first))
            if grams:
                cols = [np.concatenate(grams).view(np.int64), np.frombuffer(b"".join(ctx), np.int64), np.concatenate(keys), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "ctx", "row_key", "place"])

    return docs.select(_row_key(), F.col("text").cast("string")).mapInArrow(run, "gram long, ctx long, row_key long, place long")


def _packed(docs: DataFrame, head: str = "row_key") -> DataFrame:
    """``doc_id, row_key, packed``: texts compressed, for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "row_key", "packed"])

    return docs.select(F.col("doc_id").cast("long"), _row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key long, packed binary")


def anchor_place(data: np.ndarray) -> int:
    """Where a context's anchor begins."""
    h = gram_hashes(data[:LENGTH])
    return int(np.argmin((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)))


def split(data: bytes, contexts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, first window, bytes) of the parts that a context of an anchor with so many different ones is dealt in."""
    ranges = -(-contexts * SPAN // AT_ONCE)
    if ranges <= 1:
        yield 0, 0, data
        return
    width = max(1, SPAN // ranges)
    buckets = -(-contexts // AT_ONCE) if width == 1 else 1
    place, windows, at = anchor_place(np.frombuffer(data, np.uint8)), len(data) - LENGTH + 1, 0
    while at < windows:
        # Windows that follow one another have the anchor one place further left each.
        part = (place - at) // width
        end = min(windows, place - part * width + 1)
        piece = data[at : end - 1 + LENGTH]
        yield part * buckets + (xxhash.xxh3_64_intdigest(piece) % buckets if buckets > 1 else 0), at, piece
        at = end


def _contexts(docs: DataFrame, chosen: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``gram, part, ctx, n, shift, data`` for chosen ``gram, ctx, n, contexts, row_key, place``. ``repeated``: the keys that rows share, if any do."""
    per_row = chosen.groupBy("row_key").agg(F.collect_list(F.struct("gram", "ctx", "n", "contexts", "place")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, 32):
            out: list[tuple] = []
            for packed, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = unpack.decompress(packed)
                for x in found:
                    first, more = divmod(x["place"], 256)
                    for part, shift, data in split(text[first : first + more + LENGTH], x["contexts"]):
                        out.append((x["gram"], part, x["ctx"], x["n"], shift, data))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["gram", "part", "ctx", "n", "shift", "data"])

    rows = _packed(docs).select("row_key", "packed")
    if repeated is not None:  # equal rows have one key and one text, which gives the contexts once
        rows = rows.join(repeated, "row_key", "left_anti").unionByName(rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return rows.join(per_row, "row_key").select("packed", "list").mapInArrow(run, "gram long, part long, ctx long, n long, shift int, data binary")


_MARKS = "gram long, ctx long, low array<int>, high array<int>"


def _indexed(contexts: DataFrame) -> DataFrame:
    """``gram, ctx, low, high``: the runs of repeated windows of each context, from one index for some anchors, or one part of one, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        windows, last = 0, None

        def marks() -> pa.RecordBatch:
            ids = list(held)
            found = repeated_starts([held[i][1] for i in ids], np.array([held[i][0] for i in ids]))
            kept = [(i, held[i][2], intervals(s)) for i, s in zip(ids, found, strict=True) if len(s)]
            cols = [
                pa.array([i[0] for i, _, _ in kept], pa.int64()), pa.array([i[2] for i, _, _ in kept], pa.int64()),
                pa.array([[v + shift for v in x[0]] for _, shift, x in kept], pa.list_(pa.int32())), pa.array([[v + shift for v in x[1]] for _, shift, x in kept], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(cols, ["gram", "ctx", "low", "high"])

        for b in slices(batches, 2048):
            for gram, part, ctx, n, shift, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if windows >= AT_ONCE and (gram, part) != last:
                    yield marks()
                    held, windows = {}, 0
                last = (gram, part)
                held[gram, part, ctx, shift] = (n, data, shift)
                windows += len(data) - LENGTH + 1
        if held:
            yield marks()

    dealt = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part")
    return dealt.mapInArrow(run, _MARKS)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal spans of bytes that windows from each start to each end cover, in order."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], np.maximum.accumulate(ends[order] + LENGTH)
    opens = np.concatenate([[True], low[1:] > high[:-1]])
    at = np.flatnonzero(opens)
    return low[at], high[np.concatenate([at[1:], [len(low)]]) - 1]


def remove(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans array<struct<start,end>>, kept binary``, one row per row of ``docs``.

    Null texts are empty. Rows that repeat, and rows that share a doc_id, are texts of their own:
    a repeated row of ``LENGTH`` bytes or more loses all. Further columns are ignored; an empty
    table gives no rows. ``kept`` need not be valid UTF-8.
    """
    return _removed(docs, marks(docs), with_text=True)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what ``remove`` gives."""
    return _removed(docs, marks(docs), with_text=False)


def marks(docs: DataFrame) -> DataFrame:
    """``row_key, low, high``: lists of the runs of repeated windows of each text that has any."""
    # Written out before the joins: with a shuffle of its own on both sides, Spark can split the part that a frequent anchor fills.
    every = cut(occurrences(docs), "occurrences")
    twice = cut(every.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "twice")
    flagged = cut(every.join(twice, "gram", "left_semi"), "flagged")
    dropped(every, twice)
    each = flagged.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "place")).alias("at"))
    each = cut(each.select("gram", "ctx", "n", "at.row_key", "at.place"), "each")
    crowds = cut(each.groupBy("gram").agg(F.count("*").alias("contexts")).where(F.col("contexts") * SPAN > AT_ONCE), "crowds")
    chosen = each.join(crowds, "gram", "left").withColumn("contexts", F.coalesce("contexts", F.lit(1).cast("long")))
    repeated = cut(docs.select(_row_key()).groupBy("row_key").count().where("count > 1").select("row_key"), "repeated")
    found = cut(_indexed(_contexts(docs, chosen, None if repeated.isEmpty() else repeated)), "marks")
    dropped(each, crowds, repeated)
    first = F.floor(F.col("place") / 256).cast("int")
    moved = lambda c: F.transform(c, lambda x: first + x)
    # A set: what all copies of a row have in common is combined before the shuffle, and is no more than one text's.
    placed = flagged.join(found, ["gram", "ctx"]).select("row_key", F.struct(moved("low").alias("low"), moved("high").alias("high")).alias("runs"))
    runs = placed.groupBy("row_key").agg(F.collect_set("runs").alias("runs"))
    return runs.select("row_key", F.flatten(F.transform("runs", lambda r: r["low"])).alias("low"), F.flatten(F.transform("runs", lambda r: r["high"])).alias("high"))


def _removed(docs: DataFrame, marked: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for doc_id, packed, low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data = unpack.decompress(packed)
                spans: list[tuple[int, int]] = []
                if low.is_valid and len(low.values):
                    a, z = covered(len(data), low.values.to_numpy(), high.values.to_numpy())
                    spans = list(zip(a.tolist(), z.tolist(), strict=True))
                at, parts = 0, []
                for x, y in spans:
                    parts.append(data[at:x])
                    at = y
                kept = b"".join([*parts, data[at:]])
                row = doc_id, len(data), len(data) - len(kept)
                out.append((*row, [{"start": x, "end": y} for x, y in spans], kept) if with_text else (*row, len(spans), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64()] * 3 + ([span, pa.binary()] if with_text else [pa.int64(), pa.string()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", *(["spans", "kept"] if with_text else ["n_spans", "kept_sha256"])]
    last = "spans array<struct<start:long,end:long>>, kept binary" if with_text else "n_spans long, kept_sha256 string"
    rows = _packed(docs).join(marked, "row_key", "left").select("doc_id", "packed", "low", "high")
    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, {last}")
