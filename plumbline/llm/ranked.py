"""Ranked lexical search, score at a time over impact-ordered postings.

A posting's impact is what its term adds to its document's score. In each shard of documents the
postings of a term are grouped by exact impact. For an item, the groups of its terms are gone
through by descending impact, and their documents' scores grow. What a document can still gain
is at most the sum, over the terms, of the impact of the next group. When the best k are ahead of
all others by more than that, they are proven, and their scores are completed from their own terms.

Only postings of the items' terms are made. Items come in blocks of bounded size, whose terms go to
all tasks; documents stay where they are read, and only each task's best k of an item are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.session import cut, dropped, slices

#: Bytes that part terms become spaces, and A-Z lower case; bytes of other characters are as they are.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Items and terms (with repeats) of a block; postings and documents of a shard.
ITEMS, ITEM_TERMS = 4_000, 400_000
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 50_000

_POSTINGS = "doc_id long, n long, terms binary, counts binary, df_terms array<int>, df array<long>, docs long, words long"
_POSTINGS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()),
    ("df_terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("docs", pa.int64()), ("words", pa.int64()),
])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(_FOLD).split()


def blocks(items: DataFrame) -> Iterator[dict]:
    """Items by id, with their terms' repeats, some at a time. Rows of one id are one item."""
    found: dict = {}
    size, last = 0, object()
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).sort("item_id").toLocalIterator():
        if row["item_id"] != last and (len(found) >= ITEMS or size >= ITEM_TERMS):
            yield found
            found, size = {}, 0
        last = row["item_id"]
        new = terms(row["text"])
        found.setdefault(last, Counter()).update(new)
        size += len(new)
    if found:
        yield found


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document that has some term of the vocabulary, and one for each task with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_words = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                n_docs += bool(words)
                n_words += len(words)
                tf = Counter(k for k in map(vocabulary.get, words) if k is not None)
                if tf:
                    ids = np.fromiter(tf.keys(), np.int32, len(tf))
                    df[ids] += 1
                    out.append({"doc_id": doc_id, "n": len(words), "terms": ids.tobytes(), "counts": np.fromiter(tf.values(), np.int64, len(tf)).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, _POSTINGS_ARROW)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"df_terms": there.astype(np.int32).tolist(), "df": df[there].tolist(), "docs": n_docs, "words": n_words}], _POSTINGS_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _POSTINGS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """What a term weighs, by the documents that hold it."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """Some documents' postings, grouped by term and exact impact, and again by document."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int):
        m = 75 + (25 * n * n_docs) // n_words
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
        kept = impact > 0
        self.owner, self.term, self.impact = owner[kept], term[kept], impact[kept]
        self.own = np.searchsorted(self.owner, np.arange(len(n) + 1))  # postings come by document
        order = np.lexsort((-self.impact, self.term))
        by_term, by_impact = self.term[order], self.impact[order]
        self.docs = self.owner[order]
        new = np.flatnonzero(np.r_[True, (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])]) if len(order) else np.zeros(0, np.int64)
        self.start, self.level = np.r_[new, len(order)], by_impact[new]
        self.of_term = np.searchsorted(by_term[new], np.arange(len(weight) + 1))
        self.scores, self.repeats = np.zeros(len(n), np.int64), np.zeros(len(weight), np.int64)
        #: How many postings were gone through, of how many.
        self.read = self.all = 0

    def best(self, wanted: dict[int, int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the k greatest scores, with all that share the least of them, and their scores.

        None need be told that cannot reach ``floor``.
        """
        ids = np.array([t for t in wanted if self.of_term[t] < self.of_term[t + 1]], np.int64)
        if not len(ids):
            return ids, ids
        times = np.array([wanted[int(t)] for t in ids], np.int64)
        begin, sizes = self.of_term[ids], self.of_term[ids + 1] - self.of_term[ids]
        base = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(ids)), sizes)
        group = np.arange(sizes.sum()) - base[which] + begin[which]
        gain = self.level[group] * times[which]
        order = np.argsort(-gain, kind="stable")
        lengths = (self.start[group + 1] - self.start[group])[order]
        upto = np.cumsum(lengths)
        self.all += int(upto[-1])
        scores, done, step = self.scores, 0, max(256, int(upto[-1]) // 32)
        proven, touched = None, []
        while done < len(order):
            end = min(len(order), int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step)) + 1)
            at = order[done:end]
            size = lengths[done:end]
            where = np.repeat(self.start[group[at]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            held = self.docs[where]
            np.add.at(scores, held, np.repeat(gain[at], size))
            touched.append(held)
            self.read += len(held)
            done, step = end, 2 * step
            after = np.bincount(which[order[:done]], minlength=len(ids))
            left = after < sizes
            more = int(gain[(base + after)[left]].sum())
            if not more:
                break
            seen = np.unique(np.concatenate(touched))
            touched = [seen]
            if len(seen) > k:
                top = np.argpartition(-scores[seen], k)
                if scores[seen[top[:k]]].min() > scores[seen[top[k]]] + more:
                    proven = seen[top[:k]]
                    break
            if scores[seen].max() + more < floor:
                proven = seen[:0]
                break
        seen = np.unique(np.concatenate(touched))
        if proven is None:  # all postings are read, so scores are whole
            if len(seen) > k:
                least = -np.partition(-scores[seen], k - 1)[k - 1]
                proven = seen[scores[seen] >= least]
            else:
                proven = seen
            whole = scores[proven].copy()
        else:
            self.repeats[ids] = times
            whole = np.array([(self.impact[a:b] * self.repeats[self.term[a:b]]).sum() for a, b in zip(self.own[proven], self.own[proven + 1], strict=True)], np.int64)
            self.repeats[ids] = 0
        scores[seen] = 0
        return proven, whole


def _searched(found: DataFrame, items: list[tuple], weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """Each task's best k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]

        def search(ids: list, n: list, lengths: list, term: list, tf: list) -> None:
            owner = np.repeat(np.arange(len(ids)), lengths)
            shard = Shard(np.array(n, np.int64), owner, np.frombuffer(b"".join(term), np.int32).astype(np.int64), np.frombuffer(b"".join(tf), np.int64), weight, n_docs, n_words)
            for q, (_, wanted) in enumerate(items):
                docs, scores = shard.best(wanted, k, best[q][-1][0] if len(best[q]) == k else 0)
                new = [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                if new:
                    best[q] = sorted(best[q] + new, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in slices(batches, 1024):
            lists = [batch.column(c).to_pylist() for c in range(4)]
            for doc_id, n, term, tf in zip(*lists, strict=True):
                for to, x in zip(held, (doc_id, n, len(term) // 4, term, tf), strict=True):
                    to.append(x)
                size += len(term) // 4
                if size >= SHARD_POSTINGS or len(held[0]) >= SHARD_DOCS:
                    search(*held)
                    held, size = ([], [], [], [], []), 0
        if held[0]:
            search(*held)
        rows = [(items[q][0], d, s) for q, top in enumerate(best) for s, d in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    return found.where("terms is not null").select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest scores above 0 for each item, equal scores by doc_id.

    Every row of ``docs`` is a document, also where ids repeat; rows of ``items`` with one id, or
    with none, are one item. Null texts have no terms; a null doc_id comes last of its score; an
    item without terms in any document has no rows; empty tables give none. Further columns
    are ignored. All numbers but the weights' logarithms are 64-bit integers.
    """
    parts = []
    for block in blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
        found = cut(postings(docs, vocabulary), "postings")
        total = found.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        df = np.zeros(len(vocabulary), np.int64)
        pairs = found.where("df_terms is not null").select(F.explode(F.arrays_zip("df_terms", "df")).alias("x"))
        for row in pairs.groupBy(F.col("x.df_terms").alias("t")).agg(F.sum("x.df").alias("df")).collect():  # no more rows than the block has terms
            df[row["t"]] = row["df"]
        asked = [(i, {vocabulary[t]: r for t, r in wanted.items()}) for i, wanted in block.items() if wanted]
        best = _searched(found, asked, weights(df, total["docs"] or 0), total["docs"] or 0, total["words"] or 0, k)
        place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        parts.append(cut(best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked"))
        dropped(found)
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
