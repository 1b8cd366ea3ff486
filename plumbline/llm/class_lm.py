"""Language-model scores of texts by Brown's class-based bigrams.

Each word of the training texts belongs to one class. A token's probability is that of its class
after the class of the token before, times that of the word within its class. Transitions are
smoothed towards the classes' shares and emissions by a small count for each word, so that a
transition that was never seen leaves the base probability of the word, and all sum to one over
the known words and one unknown.

Exchange clustering finds the classes: in turn, a third of the words move each to the class in
which their occurrences, with their own counts taken out, are likeliest, given the classes of all
others. All words and all counts of the training texts take part.

Words are not shuffled one by one. Each task codes its texts as numbers of a vocabulary of its own,
a block, and deals this vocabulary to buckets of words by hash. A bucket numbers its words and keeps
their classes. In each round a block is told its words' classes, and tells the buckets how often
their words stood beside which class; the sums of transitions, a square of ``CLASSES``, are all that
the driver gathers. Blocks and buckets are of bounded size, and their number grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import cut, dropped, slices

#: Classes, the first for a text's end alone; rounds, in each of which a third of the words may move.
CLASSES, ROUNDS, PHASES = 64, 6, 3
#: The count that smooths words, and the weight, in tokens, of the classes' shares in a transition.
LEAST, SHARES = 0.1, 50.0
#: Tokens of a block; the bytes of text that one bucket of words stands for, in a small corpus.
BLOCK_TOKENS, BUCKET_BYTES = 4_000_000, 1 << 24
END = b""
NOWHERE = -1

_ENCODED = "block long, bucket int, doc_id long, train boolean, codes binary, words binary, counts binary"
_STATE = "block long, bucket int, place binary, class binary, counts binary, words binary"


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, and the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _ints(x: np.ndarray, kind: type = np.int32) -> bytes:
    return x.astype(kind).tobytes()


def _joined(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind)


def encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each text, its tokens as the numbers of its block's vocabulary, and a row for each block and bucket with its words and their counts in training.

    ``docs`` has doc_id, train and text. A block's words are numbered by bucket.
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("codes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        numbers, held, size = _Numbers(), [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            renumbered = np.empty(len(words), np.int32)
            renumbered[order] = np.arange(len(words), dtype=np.int32)
            counts, out = np.zeros(len(words), np.int64), []
            for doc_id, train, codes in held:
                codes = renumbered[codes]
                if train:
                    np.add.at(counts, codes, 1)
                out.append({"block": block, "bucket": NOWHERE, "doc_id": doc_id, "train": train, "codes": codes.tobytes()})
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[edges[b] : edges[b + 1]]
                if len(own):
                    out.append({"block": block, "bucket": b, "words": b"\n".join([words[k] for k in own]), "counts": _ints(counts[edges[b] : edges[b + 1]], np.int64)})
            yield pa.RecordBatch.from_pylist(out, schema)

        for batch in slices(batches):
            for doc_id, train, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = tokens(text)
                held.append((doc_id, train, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield from closed()
                    block, numbers, held, size = block + 1, _Numbers(), [], 0
        if held:
            yield from closed()

    return docs.select("doc_id", "train", "text").mapInArrow(run, _ENCODED)


def numbered(vocabularies: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Each bucket's words with their counts and first classes, and where each block's words are among them.

    A word begins in a class by its hash; one that training has not seen is in none (``classes``).
    """

    def run(group: pa.Table) -> pa.Table:
        numbers, places, each = _Numbers(), [], []
        for words, counts in zip(group.column("words").to_pylist(), group.column("counts").to_pylist(), strict=True):
            words = words.split(b"\n")
            places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            each.append(np.frombuffer(counts, np.int64))
        total = np.zeros(len(numbers), np.int64)
        for place, counts in zip(places, each, strict=True):
            total[place] += counts  # a block has a word once
        first = np.fromiter((1 + xxhash.xxh32_intdigest(w) % (classes - 1) if w else 0 for w in numbers), np.int64, len(numbers))
        first[total == 0] = classes
        bucket = group.column("bucket")[0].as_py()
        rows = [{"block": b, "bucket": bucket, "place": p.tobytes(), "class": _ints(first[p], np.uint8)} for b, p in zip(group.column("block").to_pylist(), places, strict=True)]
        rows.append({"block": NOWHERE, "bucket": bucket, "class": _ints(first, np.uint8), "counts": total.tobytes(), "words": b"\n".join(numbers)})
        return pa.Table.from_pylist(rows, _STATE_ARROW)

    return vocabularies.groupBy("bucket").applyInArrow(run, _STATE)


_STATE_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("place", pa.binary()), ("class", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
_SIDES = ("before", "after")
_BESIDE = "bucket int, transitions array<long>, " + ", ".join(f"{s}_{x} binary" for s in _SIDES for x in ("place", "class", "count"))
_BESIDE_ARROW = pa.schema([("bucket", pa.int32()), ("transitions", pa.list_(pa.int64())), *[(f"{s}_{x}", pa.binary()) for s in _SIDES for x in ("place", "class", "count")]])


def _block(texts: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """All tokens of a block's texts, one after the other, the classes of its words, and what it was told, by bucket."""
    told = told.sort_by("bucket")
    return _joined(texts.column("codes"), np.int32), _joined(told.column("class"), np.uint8).astype(np.int64), told


def beside(texts: DataFrame, state: DataFrame, phase: int | None, classes: int = CLASSES) -> DataFrame:
    """For each bucket, how often its words of the phase stand beside which class, in each block; and each block's transitions from class to class."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return pa.Table.from_pylist([], _BESIDE_ARROW)
        x, kind, told = _block(texts, told)
        now = kind[x]
        before, after = np.roll(now, 1), np.roll(now, -1)  # an end stands before the first text and after the last
        rows = [{"bucket": NOWHERE, "transitions": np.bincount(before * classes + now, minlength=classes * classes).tolist()}]
        if phase is None:
            return pa.Table.from_pylist(rows, _BESIDE_ARROW)
        place = _joined(told.column("place"), np.int32)
        edges = np.r_[0, np.cumsum([len(p) // 4 for p in told.column("place").to_pylist()])]
        moving = np.flatnonzero((place % PHASES == phase) & (kind != 0))
        short = np.full(len(kind), -1, np.int64)
        short[moving] = np.arange(len(moving))
        at = short[x]
        picked = np.flatnonzero(at >= 0)
        ends = np.searchsorted(moving, edges)
        parts: list[dict] = [{"bucket": b} for b in told.column("bucket").to_pylist()]
        for side, other in zip(_SIDES, (before, after), strict=True):
            table = np.bincount(at[picked] * classes + other[picked], minlength=len(moving) * classes)
            cells = np.flatnonzero(table)
            word, beside = cells // classes, cells % classes
            cut_at = np.searchsorted(word, ends)
            for part, a, b in zip(parts, cut_at[:-1], cut_at[1:], strict=True):
                part |= {f"{side}_place": _ints(place[moving[word[a:b]]]), f"{side}_class": _ints(beside[a:b], np.uint8), f"{side}_count": _ints(table[cells[a:b]])}
        return pa.Table.from_pylist(rows + parts, _BESIDE_ARROW)

    known = state.where(F.col("block") != NOWHERE).select("block", "bucket", "place", "class")
    return texts.where("train").select("block", "codes").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, _BESIDE)


def transitions(found: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """How often each class follows each, over all blocks."""
    total = np.zeros(classes * classes, np.int64)
    each = found.where(F.col("bucket") == NOWHERE).select(F.posexplode("transitions").alias("k", "n")).where("n > 0")
    for row in each.groupBy("k").agg(F.sum("n").alias("n")).collect():  # the square of the classes at most
        total[row["k"]] = row["n"]
    return total.reshape(classes, classes)


def likeliest(before: np.ndarray, after: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each word in which its occurrences are likeliest, given counts of the classes beside it (word, class), its class, and the transitions.

    A word's own counts are taken out of its class, so that no class holds a word by its own weight.
    """
    total = pairs.sum(axis=1).astype(np.float64)
    share = (total + LEAST) / (total + LEAST).sum()
    log = np.log((pairs + SHARES * share) / (total + SHARES)[:, None])
    n = after.sum(axis=1, keepdims=True).astype(np.float64)
    gain = after @ log.T + before @ log - n * np.log(total + n + LEAST)
    left = np.maximum(pairs[own] - after, 0) + SHARES * share
    into = np.maximum(pairs.T[own] - before, 0) + SHARES * share[own][:, None]
    rest = np.maximum(total[own][:, None] - n, 0)
    at_home = (after * np.log(left / (rest + SHARES))).sum(axis=1) + (before * np.log(into / (total + SHARES))).sum(axis=1) - (n * np.log(rest + n + LEAST))[:, 0]
    gain[np.arange(len(own)), own] = at_home
    gain[:, 0] = -np.inf  # the end's own
    return gain.argmax(axis=1)


def moved(found: DataFrame, state: DataFrame, phase: int, pairs: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """The state after each word of the phase went to its likeliest class."""

    def run(told: pa.Table, old: pa.Table) -> pa.Table:
        if not old.num_rows:  # of no bucket
            return old.cast(_STATE_ARROW)
        blocks = old.column("block").to_pylist()
        home = blocks.index(NOWHERE)
        kind = np.frombuffer(old.column("class")[home].as_py(), np.uint8).copy()
        counts = np.frombuffer(old.column("counts")[home].as_py(), np.int64)
        n = -(-len(kind) // PHASES)
        sides = []
        for side in _SIDES:
            where = _joined(told.column(f"{side}_place"), np.int32) // PHASES * classes + _joined(told.column(f"{side}_class"), np.uint8)
            sides.append(np.bincount(where, _joined(told.column(f"{side}_count"), np.int32), n * classes).reshape(n, classes))
        own = np.arange(phase, len(kind), PHASES)
        free = own[(counts[own] > 0) & (kind[own] != 0)]
        if len(free):
            rows = free // PHASES
            for k in range(0, len(free), 50_000):
                some = rows[k : k + 50_000]
                kind[free[k : k + 50_000]] = likeliest(sides[0][some], sides[1][some], kind[free[k : k + 50_000]].astype(np.int64), pairs)
        rows = []
        for k, row in enumerate(old.to_pylist()):
            rows.append(row | {"class": kind.tobytes() if k == home else kind[np.frombuffer(row["place"], np.int32)].tobytes()})
        return pa.Table.from_pylist(rows, _STATE_ARROW)

    return found.where(F.col("bucket") != NOWHERE).groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, _STATE)


@dataclass
class Model:
    """Classes and counts. ``texts`` and ``state`` read the written ``tables``; ``pairs`` counts transitions, ``types`` the words of each class."""

    texts: DataFrame
    state: DataFrame
    pairs: np.ndarray
    types: np.ndarray
    tables: tuple[DataFrame, ...]

    @property
    def n_tokens(self) -> int:
        return int(self.pairs.sum())

    def words(self) -> DataFrame:
        """``word, class, count`` of all words of the training texts; the end is the empty word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words, kind, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    columns = [pa.array([w.decode() for w in words.split(b"\n")]), pa.array(np.frombuffer(kind, np.uint8).astype(np.int32)), pa.array(np.frombuffer(counts, np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "class", "count"])

        own = self.state.where(F.col("block") == NOWHERE).select("words", "class", "counts")
        return own.mapInArrow(run, "word string, class int, count long").where("count > 0")

    def transition(self) -> np.ndarray:
        """Probability of a class after a class; the last is that of unknown words, which no context makes likelier or less so."""
        classes = len(self.pairs)
        total = self.pairs.sum(axis=1).astype(np.float64)
        weight = total + LEAST * self.types
        unknown = LEAST / (weight.sum() + LEAST)
        share = weight / weight.sum() if weight.sum() else weight
        out = np.empty((classes + 1, classes + 1))
        out[:classes, :classes] = (1 - unknown) * (self.pairs + SHARES * share) / (total + SHARES)[:, None]
        out[classes, :classes] = (1 - unknown) * share
        out[:, classes] = unknown
        return out


def fit(docs: DataFrame, rounds: int = ROUNDS, classes: int = CLASSES) -> Model:
    """Classes of all words of ``docs(doc_id, train, text)``, by the texts with ``train``."""
    if classes > 255:
        raise ValueError("a class is a byte")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "train", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round((size / BUCKET_BYTES) ** 0.75))  # vocabularies grow more slowly than texts
    texts = cut(encoded(rows, buckets), "encoded")
    state = cut(numbered(texts.where(F.col("bucket") != NOWHERE).select("block", "bucket", "words", "counts"), classes), "state")
    only = texts.where(F.col("bucket") == NOWHERE).select("block", "doc_id", "train", "codes")
    for r in range(rounds):
        found = cut(beside(only, state, r % PHASES, classes), "beside")
        last, state = state, cut(moved(found, state, r % PHASES, transitions(found, classes), classes), "state")
        dropped(last, found)
    found = cut(beside(only, state, None, classes), "beside")
    pairs, types = transitions(found, classes), np.zeros(classes, np.int64)
    dropped(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes + 1, np.int64)
        for batch in batches:
            n += np.bincount(_joined(batch.column("class"), np.uint8), minlength=classes + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(n[:classes])], ["class", "n"])

    for row in state.where(F.col("block") == NOWHERE).select("class").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        types[row["class"]] = row["n"]
    return Model(only, state, pairs, types, (texts, state))


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def scored(model: Model) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, base_score, score`` of all texts that the model was given."""
    classes, known, kinds = len(model.pairs), model.n_tokens, int(model.types.sum())
    with np.errstate(divide="ignore"):
        moves = np.log10(model.transition())  # no word is in an empty class
    within = np.append(model.pairs.sum(axis=1) + LEAST * model.types, LEAST)
    within[within == 0] = 1
    names = [f.split()[0] for f in _SCORES.split(", ")]

    def tell(group: pa.Table) -> pa.Table:
        """Each block's words' classes and counts."""
        blocks = group.column("block").to_pylist()
        counts = np.frombuffer(group.column("counts")[blocks.index(NOWHERE)].as_py(), np.int64)
        rows = [(b, u, p, k) for b, u, p, k in zip(blocks, *(group.column(c).to_pylist() for c in ("bucket", "place", "class")), strict=True) if b != NOWHERE]
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "class": pa.array([r[3] for r in rows], pa.binary()),
            "counts": pa.array([counts[np.frombuffer(r[2], np.int32)].tobytes() for r in rows], pa.binary()),
        })

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        x, kind, told = _block(texts, told)
        counts = _joined(told.column("counts"), np.int64)
        base = np.log10((counts + LEAST) / (known + LEAST * (kinds + 1)))
        emits = np.log10((counts + LEAST) / within[kind])
        now = kind[x]
        before = np.roll(now, 1)
        sizes = np.array([len(c) // 4 for c in texts.column("codes").to_pylist()], np.int64)
        starts = np.cumsum(sizes) - sizes
        before[starts] = 0  # an end, whether training has seen one or not
        sums = [np.add.reduceat(v, starts) for v in ((counts > 0)[x].astype(np.int64), base[x], moves[before, now] + emits[x])]
        return pa.table(dict(zip(names, [texts.column("doc_id"), texts.column("train"), *map(pa.array, [sizes, *sums])], strict=True)))

    told = model.state.groupBy("bucket").applyInArrow(tell, "block long, bucket int, class binary, counts binary")
    return model.texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, _SCORES)


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``; the model learns from those that are not held out.

    A row is held out if the checksum of its doc_id as text (of the empty text, where it is null)
    is divisible by ten. A null or empty text is an end alone. Rows that repeat are scored and
    learnt each; further columns are ignored; an empty table gives no rows; where all rows are held
    out, nothing is known, and every token has probability one, as the formula says.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    model = fit(docs.select("doc_id", (F.crc32(name) % 10 != 0).alias("train"), "text"))
    found = cut(scored(model), "scores")
    dropped(*model.tables)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
