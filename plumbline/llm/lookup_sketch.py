"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text's paragraphs are its lines, cut at sentence ends and after so many words, so that an
edit touches few of them. Where there are no blanks (some scripts, encoded data), a very long word
is cut where a hash of its last characters says so, so the cuts move with the content. Each
paragraph, with its number among equal ones, becomes a 64-bit key whose last 16 bits are its
length; by construction none is longer than they can say. A key goes to three cells; a cell holds a count,
the exclusive or of its keys and of their check sums. Subtracting two tables leaves the keys
that only one version has, and peeling recovers them from cells that hold one key. Where that
gets stuck, both tables are built again with twice the cells.

The cells of a table are a power of two, chosen from the number of paragraphs alone, so equal
texts have equal fingerprints, and a larger table folds onto a smaller one.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import cut, partitions, slices

#: Words in a paragraph at most; words after which a sentence's end is its end; paragraphs for each cell of a fingerprint; fewest cells.
WORDS, ENOUGH, RATE, FEWEST = 24, 10, 4, 12
#: A word of more characters than the first is cut into pieces of the second at least, the third at most, and some 130 on average.
LONG, SHORT_PIECE, LONG_PIECE = 256, 32, 512
#: Characters whose hash tells a cut; one in so many places is one.
WINDOW, ONE_IN = 8, 128
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SHIFTS = np.array([[0], [21], [42]], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(31))


def pieces(word: str) -> list[str]:
    """A long word cut by its content: equal stretches are cut alike, wherever they lie."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(c + np.uint64(1)))])
    # The place after each window of characters.
    places = np.flatnonzero((_mixed(sums[WINDOW:] - sums[:-WINDOW]) & np.uint64(ONE_IN - 1)) == 0) + WINDOW
    out, at = [], 0
    for place in [*places.tolist(), len(word)]:
        while place - at > LONG_PIECE:
            out.append(word[at : at + LONG_PIECE])
            at += LONG_PIECE
        if place - at >= SHORT_PIECE or place == len(word) and place > at:
            out.append(word[at:place])
            at = place
    return out


def paragraphs(text: str) -> list[str]:
    """Lines, cut at sentence ends after some words, after ``WORDS`` at the latest, and within long words; white space around them is dropped."""
    out = []
    for line in text.split("\n"):
        held: list[str] = []
        for sentence in _SENTENCE.split(line) if len(line) > 6 * ENOUGH else (line,):
            words = sentence.split()
            if len(sentence) > LONG and max(map(len, words), default=0) > LONG:
                for w in words:
                    if len(w) > LONG:
                        out += [" ".join(held[i : i + WORDS]) for i in range(0, len(held), WORDS)]
                        out += pieces(w)
                        held = []
                    else:
                        held.append(w)
            else:
                held += words
            if len(held) >= ENOUGH:
                out += [" ".join(held[i : i + WORDS]) for i in range(0, len(held), WORDS)]
                held = []
        if held:
            out += [" ".join(held[i : i + WORDS]) for i in range(0, len(held), WORDS)]
    return out


def keys(text: str) -> np.ndarray:
    """The 64-bit keys of a text's paragraphs, all different."""
    seen: Counter[str] = Counter()
    out = []
    hashed = xxhash.xxh3_64_intdigest
    for p in paragraphs(text):
        seen[p] += 1
        # The number goes into the bytes: with short inputs, seeds of this hash make equal results.
        data = p.encode() if seen[p] == 1 else f"{p}\0{seen[p]}".encode()
        out.append(hashed(data) & ~0xFFFF | len(p))
    return np.unique(np.array(out, np.uint64))  # peeling needs keys that differ


class Table:
    """Cells of counts, keys and check sums, in three parts of ``cells`` each."""

    __slots__ = ("cells", "checks", "counts", "sums")

    def __init__(self, cells: int):
        self.cells = cells
        self.counts, self.sums, self.checks = np.zeros(3 * cells, np.int32), np.zeros(3 * cells, np.uint64), np.zeros(3 * cells, np.uint64)

    def add(self, key: np.ndarray, sign: int | np.ndarray = 1) -> Table:
        """Put keys in, or with sign -1 take them out."""
        if len(key):
            h = _mixed(key)
            self._put(key, h, _mixed(h), sign)
        return self

    def _put(self, key: np.ndarray, h: np.ndarray, check: np.ndarray, sign: int | np.ndarray) -> None:
        # Values are repeated by hand: ufunc.at does not broadcast them soundly.
        at = (((h >> _SHIFTS) & np.uint64(self.cells - 1)).view(np.int64) + np.array([[0], [self.cells], [2 * self.cells]])).ravel()
        np.add.at(self.counts, at, sign if isinstance(sign, int) else np.concatenate((sign, sign, sign)))
        np.bitwise_xor.at(self.sums, at, np.concatenate((key, key, key)))
        np.bitwise_xor.at(self.checks, at, np.concatenate((check, check, check)))

    def folded(self, cells: int) -> Table:
        """The same keys in fewer cells."""
        out = Table(cells)
        out.counts = self.counts.reshape(3, -1, cells).sum(axis=1, dtype=np.int32).ravel()
        out.sums, out.checks = (np.bitwise_xor.reduce(x.reshape(3, -1, cells), axis=1).ravel() for x in (self.sums, self.checks))
        return out

    def minus(self, other: Table) -> Table:
        """The keys of the one and, with negative counts, of the other; common ones cancel."""
        cells = min(self.cells, other.cells)
        a, b = (x if x.cells == cells else x.folded(cells) for x in (self, other))
        out = Table(cells)
        out.counts, out.sums, out.checks = a.counts - b.counts, a.sums ^ b.sums, a.checks ^ b.checks
        return out

    def differing(self) -> float:
        """About how many keys a subtracted table holds: they spread the counts, whatever their signs."""
        c = self.counts.astype(np.float64)
        spread = float((c * c).sum()) / 3 - (c.sum() / 3) ** 2 / self.cells
        return max(0.0, spread / (1.0 - 1.0 / self.cells)) if self.cells > 1 else float(np.abs(c).max())

    def peeled(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The keys with positive and with negative count, or None if some can't be recovered. Empties the table."""
        if np.count_nonzero(self.checks) > 2.8 * self.cells:
            return None
        keys, signs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        while True:
            pure = np.flatnonzero((self.counts == 1) | (self.counts == -1))
            key = self.sums[pure]
            h = _mixed(key)
            check = _mixed(h)
            good = np.flatnonzero(check == self.checks[pure])
            if not len(good):
                break
            if len(good) > 1:
                order = good[np.argsort(key[good])]
                good = order[np.concatenate(([True], key[order[1:]] != key[order[:-1]]))]
            sign = self.counts[pure[good]]
            keys.append(key[good])
            signs.append(sign)
            self._put(key[good], h[good], check[good], -sign)
        if self.checks.any() or self.counts.any():
            return None
        key, sign = np.concatenate(keys), np.concatenate(signs)
        return key[sign == 1], key[sign == -1]

    def hex(self, n: int) -> str:
        """The fingerprint: paragraphs, cells, then every cell."""
        return struct.pack("<II", n, self.cells).hex() + np.concatenate([self.counts.astype("<i4").view(np.uint8), self.sums.astype("<u8").view(np.uint8), self.checks.astype("<u8").view(np.uint8)]).tobytes().hex()


def cells_for(n: int) -> int:
    """Cells, in each of three parts, of a fingerprint of so many paragraphs."""
    return max(FEWEST // 3, 1 << max(0, (n // (3 * RATE)).bit_length()))


def difference(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys only in a and only in b: peeled from subtracted tables, built larger until that works.

    A larger table has at least twice the cells, and at least what the cells in use let expect.
    """
    cells = max(cells, 1 << (abs(len(a) - len(b)) // 4).bit_length())
    both, signs = np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int32), np.full(len(b), -1, np.int32)])
    while True:
        t = Table(cells).add(both, signs)
        idle = 1.0 - np.count_nonzero(t.checks) / (3 * cells)
        found = t.peeled()
        if found is not None:
            return found
        expected = -math.log(max(idle, 0.25 / cells)) * cells
        cells *= 2
        while 2.2 * cells < expected:
            cells *= 2


def length(key: np.ndarray) -> int:
    return int((key & np.uint64(0xFFFF)).sum())


def likeness(a: np.ndarray, b: np.ndarray, ta: Table, tb: Table) -> float:
    """The share of characters in common paragraphs, from 0 to 1; 1 for two texts without paragraphs."""
    rest = ta.minus(tb)
    expected = rest.differing()
    found = rest.peeled()
    if found is None:  # larger at once, by what the counts let expect
        found = difference(a, b, max(2 * min(ta.cells, tb.cells), 1 << math.ceil(math.log2(max(1.0, (1.6 * expected + 6) / 3)))))
    total = length(a) + length(b)
    return 1.0 if not total else 1.0 - (length(found[0]) + length(found[1])) / total


def sketch(text: str) -> tuple[np.ndarray, Table, str]:
    """Keys, table and fingerprint of a text."""
    own = keys(text)
    t = Table(cells_for(len(own))).add(own)
    return own, t, t.hex(len(own))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


#: An order of rows: without an id last, larger ids first, then by the hash of the text.
Key = tuple[int, int, int]
HASHES = 1 << 63


def _key(doc_id: int | None, tie: int) -> Key:
    return (1, 0, tie) if doc_id is None else (0, -doc_id, tie)


def boundaries(quantiles: list[int], nulls: int, total: int, n: int) -> list[Key]:
    """Keys at which ranges begin: at quantiles of the ids; an id that is several quantiles, and rows without one, are split by hash."""
    out = [_key(i, k * (HASHES // times)) for i, times in Counter(quantiles).items() for k in range(times)]
    parts = nulls * n // max(1, total) + 1 if nulls else 0
    return sorted([*out, *(_key(None, k * (HASHES // parts)) for k in range(parts))])


def _sent(batches: Iterator[pa.RecordBatch], splits: list[Key], guests: dict[int, tuple[Key, int]]) -> Iterator[pa.RecordBatch]:
    """Rows with their range; the first of a range also as a guest of the range before it. Texts travel compressed."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        rows: list[tuple] = []
        for i, tie, times, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            key = _key(i, tie)
            bucket = bisect_right(splits, key)
            row = (i, tie, times, pack.compress((t or "").encode()))
            rows.append((bucket, 0, *row))
            top, to = guests[bucket]
            if top == key:
                rows.append((to, 1, *row))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bucket", "guest", "doc_id", "tie", "times", "packed"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the one after it in its range, and, where it has copies, with itself, as all copies but the last are."""
    unpack = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    before = None

    def answer(own: tuple, following: tuple, times: int) -> tuple:
        doc_id, _, text, own_keys, own_table, own_print = own
        new = edited(text, following[2])
        new_keys, new_table, new_print = sketch(new)
        next_ = 1.0 if following is own else likeness(own_keys, following[3], own_table, following[4])
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own_print, new_print, likeness(own_keys, new_keys, own_table, new_table), next_, times

    for batch in slices(batches, 64):
        out = []
        for guest, doc_id, times, packed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5)), strict=True):
            if guest and before is None:
                continue
            text = unpack.decompress(packed).decode()
            now = (doc_id, times, text, *sketch(text))
            if before is not None:
                out.append(answer(before, now, 1))
            if not guest and times > 1:
                out.append(answer(now, now, times - 1))
            before = None if guest else now
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


#: Copies of an answer that one row stands for until they are listed.
LISTED = 4096


def versions(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited version, and how alike they and the next text are.

    The next document is the one before in doc_id; rows that share a doc_id are in the order of
    their texts' hashes, rows without one come last, and after the last comes the first. Null
    texts are empty. Copies of a row follow one another. A lone row is followed by itself; an
    empty table gives no rows; columns but doc_id and text are ignored. A very long text is held
    whole, with the one before it.

    Rows are dealt into ranges of that order, each with the first row of the range after it as a
    guest, so order needs no single task; a frequent id, and rows without one, are several
    ranges. Copies are one row with their number until the end. The driver holds one boundary
    for each range.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(HASHES - 1)).alias("tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie, F.lit(1).cast("long").alias("times"), F.col("text").cast("string").alias("text"))
    keys_ = cut(rows.select("doc_id", "tie"), "keys")
    copies = cut(keys_.groupBy("doc_id", "tie").agg(F.count("*").alias("times")).where("times > 1"), "copies")
    copied = not copies.isEmpty()
    if copied:
        on = [F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("r.tie") == F.col("c.tie")]
        once = rows.alias("r").join(copies.alias("c"), on, "left_anti")
        several = rows.alias("r").join(copies.alias("c"), on).select("r.doc_id", "r.tie", "c.times", "r.text")
        rows = once.unionByName(several.groupBy("doc_id", "tie", "times").agg(F.first("text").alias("text")))
        keys_ = cut(keys_.distinct(), "keys")

    n = buckets or 4 * partitions(spark)
    told = keys_.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q") if n > 1 else F.lit(None).alias("q"), F.count("*").alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    splits = boundaries(told["q"] or [], told["nulls"], told["total"], n)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each range, of those that a task reads."""
        best: dict[int, tuple[Key, int | None]] = {}
        for b in batches:
            for i, tie in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = _key(i, tie)
                bucket = bisect_right(splits, key)
                if bucket not in best or key < best[bucket][0]:
                    best[bucket] = (key, i)
        cols = [[b for b in best], [best[b][1] for b in best], [best[b][0][2] for b in best]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["bucket", "doc_id", "tie"])

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie")).alias("top")
    found = keys_.mapInArrow(tops, "bucket int, doc_id long, tie long").groupBy("bucket").agg(first).collect()  # one row for each range
    firsts = {r["bucket"]: _key(None if r["top"]["last"] else -int(r["top"]["down"]), r["top"]["tie"]) for r in found}
    order = sorted(firsts)
    guests = {b: (firsts[b], order[k - 1]) for k, b in enumerate(order)}
    sent = rows.mapInArrow(lambda it: _sent(it, splits, guests), "bucket int, guest int, doc_id long, tie long, times long, packed binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie", "packed")
    answers = dealt.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    if not copied:
        return answers.drop("times")
    # A row's copies are listed by many tasks, however many there are.
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LISTED)), lambda k: F.least(F.lit(LISTED).cast("long"), F.col("times") - k * LISTED))
    shares = cut(answers, "answers").withColumn("share", F.explode(parts)).repartition(partitions(spark))
    return shares.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share")))).drop("times", "share", "copy")
