"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

With M the largest norm, (x, sqrt(M^2 - |x|^2)) turns largest inner product into smallest
Euclidean distance. Each of a few tables hashes a vector by several Gaussian projections cut
into cells of one width. A projection of the difference to a row at distance r is normal with
deviation r, which tells with what probability such a row lies in each cell around the query's
place. A query visits buckets in the order of that probability, its own and perturbed ones, until
they add up to the success asked of a table; so the number of probes follows from the query, and
recall from ``success``. All rows of the visited buckets are ranked by their exact inner
products, and the tables' best are merged.

The settings follow from the data: projections from the logarithm of the number of vectors, so a
bucket's size hardly grows, widths from the largest norm, and r from the distances at which a
bounded sample of vectors has its k-th neighbours among all rows. On vectors of weak contrast (64
dimensions, even in all directions) most buckets must be visited: by simulation at a success of
0.5 a table, 0.86 of 2,000 rows, 0.79 of 10,256 and 0.57 of 51,282, for a recall of 0.94 to 0.96.

Buckets are dealt in parts of about ``BLOCK`` vectors. Equal vectors are one entry that carries its
least ids; a larger bucket is split into blocks, all of which its visitors visit. Nothing is capped, so
the results are the exact best of all candidates. The cells that a query visits are not listed one by one:
it carries what a cell costs by projection, and the cost of the last one that it visits, and so is one row for
a table, however many cells there are. Parts are dealt to lanes and queries by hash to sets of about ``WIDE *
ASKED``, each of which gets all vectors. A task reads a lane's parts one after another, finds in each the
buckets that its queries visit, ``ASKED`` queries at a time, and carries each query's best along. So it holds a
part, a set and their lists, and gives k + 1 rows a query, however many parts there are. Lanes are as many
as leave ``SHARE`` vectors to each query and lane, so rows grow with the input, and few queries still have many tasks.
A query that found fewer than k rows is compared with all rows, in parts, lanes and sets as well, so its list is full.

Cells more than ``AROUND`` from a query's own are not visited: with the registered settings a near
row lies there with a probability of 2e-4 a projection at most, which is within the share that
``success`` leaves, and measured recall includes it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.session import cut

#: Tables; cells' width, in largest norms; share of the k nearest that is sought.
TABLES, WIDTH, SUCCESS = 4, 2.5, 0.95
#: Projections are the binary logarithm of the vectors less this, within limits.
LESS, FEWEST, MOST = 6, 2, 24
#: Distinct vectors in a part, about; salts of the ids of one vector; vectors whose neighbours tell the distance.
BLOCK, SALTS, SAMPLE = 8192, 64, 64
#: Queries that meet a part's vectors at once; times that in a set, about; vectors to each query and lane.
ASKED, WIDE, SHARE = 4096, 2, 7
#: The quantile of the sample's distances for which success is asked.
FAR = 0.75
#: Cells on either side of a query's own that may be visited.
AROUND = 3


def _normal(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def visits(place: np.ndarray, width: float, distance: float, success: float) -> Iterator[np.ndarray]:
    """The cells, by projection, in which a row at ``distance`` from a query at ``place`` most likely lies, the likeliest first, until they hold it with the probability ``success``."""
    own = np.floor(place / width)
    best, costs = own.copy(), []
    log_all = 0.0
    for j, (p, c) in enumerate(zip(place.tolist(), own.tolist(), strict=True)):
        cells = [(_normal(((c + d + 1) * width - p) / distance) - _normal(((c + d) * width - p) / distance), c + d) for d in range(-AROUND, AROUND + 1)]
        cells.sort(key=lambda x: -x[0])
        best[j] = cells[0][1]
        log_all += math.log(cells[0][0])
        costs += [(math.log(cells[0][0] / q), j, cell) for q, cell in cells[1:] if q > 1e-12]
    costs.sort()
    yield best
    held, heap = math.exp(log_all), [(costs[0][0], (0,))] if costs else []
    while heap and held < success:
        total, chosen = heapq.heappop(heap)
        moved = [costs[i] for i in chosen]
        if len({j for _, j, _ in moved}) == len(moved):
            cell = best.copy()
            for _, j, c in moved:
                cell[j] = c
            held += math.exp(log_all - total)
            yield cell
        last = chosen[-1]
        if last + 1 < len(costs):
            rest = total - costs[last][0]
            heapq.heappush(heap, (rest + costs[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + costs[last + 1][0], (*chosen, last + 1)))


def reach(place: np.ndarray, width: float, distance: float, success: float) -> np.ndarray:
    """The cells of ``visits``, in as many numbers for any count of them: the cost of the last, its own cells by projection, and by projection what each cell around its own costs."""
    own = np.floor(place / width)
    held = np.array([[_normal(((c + d + 1) * width - p) / distance) - _normal(((c + d) * width - p) / distance) for d in range(-AROUND, AROUND + 1)] for p, c in zip(place.tolist(), own.tolist(), strict=True)]).reshape(len(place), 2 * AROUND + 1)
    best = held.max(axis=1, keepdims=True)
    costs = np.where((held > 1e-12) | (held == best), np.log(best) - np.log(np.maximum(held, 1e-300)), np.inf)
    last = own
    for last in visits(place, width, distance, success):
        pass
    at = (last - own).astype(int) + AROUND
    return np.concatenate([[costs[np.arange(len(own)), at].sum() + 1e-9], own, costs.ravel()])


def visited(reaches: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the cells (cells x projections) each query visits, by its ``reach``."""
    n, wide = cells.shape[1], 2 * AROUND + 1
    own, costs = reaches[:, 1 : n + 1].astype(np.int64), reaches[:, n + 1 :].reshape(len(reaches), n, wide)
    total = np.zeros((len(reaches), len(cells)))
    for j in range(n):
        at = cells[None, :, j] - own[:, j, None] + AROUND
        total += np.where((at >= 0) & (at < wide), np.take_along_axis(costs[:, j], at.clip(0, wide - 1), 1), np.inf)
    return total <= reaches[:, :1]


class Hashes:
    """The projections; the same for the same seed and dimension."""

    def __init__(self, dim: int, most: float, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.normal(size=(tables, projections, dim + 1)), rng.uniform(0, width, size=(tables, projections))
        self.mix = rng.integers(1, 1 << 62, size=projections, dtype=np.int64) | 1
        self.most, self.width = most, width

    def places(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """The projections of rows: rows x tables x projections."""
        x = x / self.most
        extra = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.einsum("tpd,nd->ntp", self.a, np.column_stack([x, extra])) + self.b

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.mix).sum(axis=-1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def kth_distance(entries: DataFrame, dim: int, most: float, k: int) -> float:
    """The distance, in largest norms, within which most vectors have their k nearest: of ``SAMPLE`` vectors, chosen by a hash, among all."""
    order = [F.xxhash64("rep"), F.col("rep")]
    sample = np.array([r["v"] for r in entries.orderBy(*order).limit(SAMPLE).collect()])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(sample), 0))
        for b in batches:
            both = np.concatenate([best, sample @ _matrix(b.column(0), dim).T], axis=1)
            best = -np.partition(-both, k, axis=1)[:, : k + 1] if both.shape[1] > k + 1 else both
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sample)), pa.int32()), pa.array(best.tolist(), pa.list_(pa.float64()))], ["sample", "scores"])

    found = entries.select("v").mapInArrow(nearest, "sample int, scores array<double>")
    # The k-th without itself, or the last if there are fewer. One task merges k + 1 numbers of each task above.
    scores = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k + 1)
    last = {r["sample"]: r["s"] for r in found.groupBy("sample").agg(F.element_at(scores, -1).alias("s")).collect()}
    squared = [max(0.0, 1.0 + ((sample[i] ** 2).sum() - 2.0 * s) / most**2) for i, s in last.items()]
    return max(1e-6, float(np.sqrt(np.quantile(squared, FAR))))


def _ranked(dim: int, k: int):
    """Rows of ``bucket, rep, v`` against queries ``q, buckets, v``: the k + 1 best of each query in the buckets that it visits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return nothing
        bucket = left.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        x, rep = _matrix(left.column("v").combine_chunks(), dim)[order], left.column("rep").to_numpy()[order]
        names, begin = np.unique(bucket[order], return_index=True)
        end = np.concatenate([begin[1:], [len(x)]])
        q, qid = _matrix(right.column("v").combine_chunks(), dim), right.column("q").to_numpy()
        lists = right.column("buckets").combine_chunks()
        wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        known = names[at] == wanted  # no row is in the others
        at, owner = at[known], owner[known]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(q), 256):
            here = np.flatnonzero((owner >= first) & (owner < first + 256))
            here = here[np.argsort(at[here], kind="stable")]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for own in np.split(here, np.flatnonzero(np.diff(at[here])) + 1) if len(here) else []:
                a, z = begin[at[own[0]]], end[at[own[0]]]
                scores, keep = q[owner[own]] @ x[a:z].T, min(k + 5, z - a)
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                low = np.take_along_axis(scores, best, 1).min(axis=1) - 1e-9
                # Product rounding depends on the block's shape, so the last ones' ties are kept, and finalists summed anew.
                i, j = np.nonzero(scores >= low[:, None])
                found.append((owner[own][i], a + j, scores[i, j]))
            if not found:
                continue
            i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((-score, i))
            i, j, score = i[order], j[order], score[order]
            start = np.searchsorted(i, i)
            last = np.minimum(start + k, np.searchsorted(i, i, side="right") - 1)
            finalists = score >= score[last] - 1e-9
            i, j = i[finalists], j[finalists]
            exact = (x[j] * q[i]).sum(axis=1)
            order = np.lexsort((rep[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) <= k
            out.append((qid[i[top]], rep[j[top]], exact[top]))
        if not out:
            return nothing
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"q": a, "rep": b, "score": c})

    return run


def _carried(dim: int, k: int):
    """The k + 1 best rows of each query of a set, over all parts of a lane.

    First come the queries (``kind`` 0: ``id, x`` as their ``reach``, ``v``), then the vectors, part by
    part (1: ``id, x`` as their cells, ``bucket, v``).
    """
    ranked, asked = _ranked(dim, k), ASKED

    def best(q: np.ndarray, rep: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rep, -score, q))
        q, rep, score = q[order], rep[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) <= k
        return q[top], rep[top], score[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.RecordBatch] = []
        part: list[pa.RecordBatch] = []
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids = x = reaches = None

        def met() -> None:
            """A part is there: its visitors' best are added, and merged once they are as many as what is held."""
            nonlocal held, new, ids, x, reaches
            if queries and part:
                if x is None:
                    them = pa.Table.from_batches(queries)
                    ids, x, reaches = them.column("id").to_numpy(), _matrix(them.column("v").combine_chunks(), dim), _matrix(them.column("x").combine_chunks(), len(them.column("x")[0]))
                rows = pa.Table.from_batches(part)
                left = rows.select(["bucket", "id", "v"]).rename_columns(["bucket", "rep", "v"])
                names, first = np.unique(left.column("bucket").to_numpy(), return_index=True)
                cells = np.array(rows.column("x").take(pa.array(first)).to_pylist(), np.int64).reshape(len(names), -1)
                for i in range(0, len(ids), asked):
                    who, bucket = np.nonzero(visited(reaches[i : i + asked], cells))
                    here, counts = np.unique(who, return_counts=True)
                    if len(here):
                        starts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
                        v = pa.FixedSizeListArray.from_arrays(pa.array(x[i + here].ravel()), dim)
                        found = ranked(left, pa.table({"q": ids[i + here], "buckets": pa.LargeListArray.from_arrays(starts, pa.array(names[bucket])), "v": v}))
                        new.append(tuple(c.to_numpy() for c in found.columns))
                if sum(len(n[0]) for n in new) >= len(held[0]):
                    held, new = best(*(np.concatenate(c) for c in zip(held, *new, strict=True))), []
            part.clear()

        last = None
        for b in batches:
            at = np.column_stack([b.column(c).to_numpy() for c in ("kind", "part", "block")])
            changes = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
            for i, j in zip([0, *changes], [*changes, len(at)], strict=True):
                if i == j:
                    continue
                place = tuple(at[i].tolist())
                if last is not None and place < last:
                    raise RuntimeError("rows of a set are not in order")
                if place != last:
                    met()
                (part if place[0] else queries).append(b.slice(i, j - i))
                last = place
        met()
        q, rep, score = best(*(np.concatenate(c) for c in zip(held, *new, strict=True)))
        for i in range(0, len(q), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in (q, rep, score)], ["q", "rep", "score"])

    return run


def _best(dealt: DataFrame, sent: DataFrame, n: int, asking: int, dim: int, k: int) -> DataFrame:
    """``q, rep, score``: of ``dealt(t, part, block, bucket, x, rep, v)``, n vectors in each table, the k + 1 best in each table and lane of each of the queries ``sent(t, q, x, v)``."""
    lanes = max(1, min(-(-n // BLOCK), round(n / (SHARE * max(1, asking)))))
    sets = max(1, -(-asking // (WIDE * ASKED)))
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    keys, order = ["t", "lane", "set"], ["kind", "part", "block"]
    queries = sent.select("t", all_of(lanes).alias("lane"), F.pmod(F.xxhash64("q"), F.lit(sets)).cast("int").alias("set"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("block"), F.col("q").alias("id"), "x", F.lit(0).cast("long").alias("bucket"), "v")
    lane = F.pmod(F.pmod("part", F.lit(lanes)) + F.col("block"), F.lit(lanes)).cast("int").alias("lane")
    rows = dealt.select("t", lane, all_of(sets).alias("set"), F.lit(1).alias("kind"), "part", "block", F.col("rep").alias("id"), "x", "bucket", "v")
    ordered = queries.unionByName(rows).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.groupBy(*keys).applyInArrow(_carried(dim, k), "q long, rep long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, projections: int | None = None, width: float = WIDTH, success: float = SUCCESS, seed: int = 1) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k nearest found among all rows of ``vectors`` but its own.

    ``vectors(vec_id, embedding)``; ``queries(vec_id)`` are ids of rows in it. Null vectors, zero
    ones, those with null or non-finite components, and those of a dimension other than the most
    frequent take no part, neither as queries. Ties go to the smaller vec_id. Rows that share a
    vec_id are candidates each, of which a query leaves out one as its own. A list has k rows, or
    all others if there are fewer. Further columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(sound)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return nothing
    dim = dims["dim"]
    rows = cut(rows.where(F.size("v") == dim), "vectors")
    most = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]

    # Equal vectors: the least k + 1 ids are all that can be in any list. Salted, so that no task gathers a hot vector's ids.
    own_ids = lambda ids: F.slice(F.sort_array(ids), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(own_ids(F.collect_list("vec_id")).alias("ids"))
    entries = cut(salted.groupBy("v").agg(own_ids(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids"), "entries")
    asked = rows.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
    asked = cut(asked.join(entries.select("v", F.col("rep").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q"), "asked")
    sought = cut(entries.join(asked.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("q"), "v"), "sought")
    total, n = dims["count"], entries.count()
    if projections is None:
        projections = max(FEWEST, min(MOST, round(math.log2(n)) - LESS))
    distance = kth_distance(entries.select("rep", "v"), dim, most, k)
    each = 1.0 - (1.0 - success) ** (1.0 / tables)
    hashes = Hashes(dim, float(most), tables, projections, width, seed)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.floor(hashes.places(_matrix(b.column(1), dim), False) / width)
            keys = hashes.bucket(cells)
            for t in range(tables):
                x = pa.FixedSizeListArray.from_arrays(pa.array(cells[:, t].ravel()), cells.shape[2]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), x, b.column(0), b.column(1)], ["t", "bucket", "x", "rep", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = hashes.places(_matrix(b.column(1), dim), True)
            for t in range(tables):
                x = [reach(place[i, t], width, distance, each) for i in range(len(place))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(1)], ["t", "q", "x", "v"])

    index = entries.select("rep", "v").mapInArrow(hashed, "t int, bucket long, x array<double>, rep long, v array<double>")
    sent = sought.repartition(spark.sparkContext.defaultParallelism).mapInArrow(probed, "t int, q long, x array<double>, v array<double>")
    # Buckets are dealt by hash into parts; those larger than a part are parts of their own, in blocks.
    large = cut(index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1"), "large")
    part = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("bucket"), F.lit(-(-n // BLOCK)))).otherwise(F.col("bucket")).alias("part")
    dealt = index.join(large, ["t", "bucket"], "left").select("t", part, F.when(F.col("n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("rep"), "n")).cast("int").alias("block"), "bucket", "x", "rep", "v")
    found = _best(dealt, sent, n, sought.count(), dim, k)
    answers = cut(_lists(asked, found, entries, k), "answers")

    full = answers.where(F.size("list") >= min(k, total - 1)).select("query_id", "q").distinct()
    short = cut(asked.join(full, ["query_id", "q"], "left_anti"), "short")
    if not short.isEmpty():  # too few rows in the buckets visited: all rows, in parts
        parts = -(-n // BLOCK)
        none, all_cells = F.array().cast("array<double>").alias("x"), F.array(F.lit(0.0)).alias("x")
        every = entries.select(F.lit(0).alias("t"), F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("part"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("bucket"), none, "rep", "v")
        them = cut(sought.join(short.select("q").distinct(), "q", "left_semi").select(F.lit(0).alias("t"), "q", all_cells, "v"), "them")
        found = _best(every, them, n, them.count(), dim, k)
        answers = answers.join(short, ["query_id", "q"], "left_anti").unionByName(_lists(short, found, entries, k))
    return answers.select("query_id", F.posexplode("list").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _lists(asked: DataFrame, found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``query_id, q, list``: of what was found for the vectors of queries, the k best rows but the query's own."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    near = found.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    rows_of = near.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    listed = rows_of.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("list"))
    own: Column = F.coalesce(F.array_position(F.transform("list", lambda x: x["vec_id"]), F.col("query_id")), F.lit(0))
    return asked.join(lists, "q").withColumn("own", own).select("query_id", "q", F.slice(F.filter("list", lambda x, i: i + 1 != F.col("own")), 1, k).alias("list"))
