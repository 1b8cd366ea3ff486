"""The operators on small fixtures: brute force, odd rows (nulls, repeats, empty tables, clashing names) and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, components, language_id, lookup_sketch, mixing, neighbours, page_text, queries, repeats, secret_scan, similar, simhash
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, ids int, row_key string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, "k") for i, t, s in rows], DOCS)


ODD = [(1, "one two three", "a"), (1, "one two three", "a"), (1, "other", None), (None, "no id", "a"), (2, None, None), (3, "", "b"), (4, "x " * 30_000, "b")]


def sql(query):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.sql(query)
    names = found.columns
    order = sorted(names)
    return order, sorted(str([r[names.index(c)] for c in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert (order, sorted(str([r[c] for c in order]) for r in df.collect())) == sql(queries.ORACLES[name])


# Mixing


def test_mix_odd_rows(spark):
    got = mixing.mix(docs(spark, *ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs(spark, *ODD).where("false")).count() == 0
    assert mixing.mixed(docs(spark, *ODD)).columns == docs(spark, *ODD).columns


def test_mix_meets_targets(spark):
    random.seed(1)
    rows = [(i, "w " * random.randint(1, 300), random.choice("aaaabc")) for i in range(4000)]
    df = docs(spark, *rows)
    got = mixing.mix(df).groupBy(F.col("source_size")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got)
    assert abs(sum(r["target"] for r in got) - 1.5 * sum(len(t.split()) for _, t, _ in rows)) < 1e-6
    once = sorted(map(tuple, mixing.mix(df).collect()))
    assert once == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed(df).count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_mixed_tells_rows_apart(spark):
    """Equal rows, and rows that differ in one column only, are taken as often as the mix says, whatever else there is."""
    rows = [(7, "a b c", "en", "a", 1, "x", 1, "k")] * 300 + [(7, "a b c", "fr", "a", 1, "x", 1, "k")] * 200 + [(i, "w " * (i % 9), "en", "b", 2, "y", 2, "z") for i in range(100)]
    df = spark.createDataFrame(rows, DOCS)
    old, mixing.LISTED = mixing.LISTED, 64
    try:
        each = mixing.mix(df)
        assert each.count() == len(rows) and each.where("taken > 2 * size").isEmpty()
        out = mixing.mixed(df)
        assert out.columns == df.columns and out.count() == each.agg(F.sum("copies")).first()[0]
        n = {r["lang"]: r["count"] for r in out.where("doc_id = 7 and source = 'a'").groupBy("lang").count().collect()}
        rate = each.where("source_size = 1500").select((F.col("target") / F.col("source_size")).alias("r")).first()["r"]
        assert abs(n["en"] - 300 * rate) <= 1 and abs(n["fr"] - 200 * rate) <= 1
        assert sorted(map(tuple, each.collect())) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    finally:
        mixing.LISTED = old


# Secrets


def brute_secrets(text):
    out = []
    for order, r in enumerate(secret_scan.BASE):
        flags = re.I | re.A if r.any_case else re.A
        for m in re.finditer({"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(r.kind, r.regex), text, flags):
            if len(m[r.value] if r.value else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[r.kind]:
                out.append((m.start(), order, r.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets(spark):
    random.seed(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "😀", "a" * 7, "\n"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 12))), "s") for i in range(800)]
    df = docs(spark, *rows, *ODD)
    got = secret_scan.scan(df, secret_scan.BASE).select("doc_id", "text", secret_scan.told(F.col("spans")).alias("told")).collect()
    assert len(got) == len(rows) + len(ODD)
    want = [brute_secrets(r["text"] or "") for r in got]
    assert sum(bool(w) for w in want) > 50
    assert [r["told"] for r in got] == want
    clean = secret_scan.redact(docs(spark, (1, "a password = hunter22 b", "s"), (2, None, "s"))).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["a [SECRET] b", None]
    assert secret_scan.scan(df.where("false")).count() == 0


def test_own_columns_and_many_secrets(spark):
    df = spark.createDataFrame([(1, "x password = hunter22 y", "own", 7), (2, None, None, None)], "doc_id long, text string, _spans string, __spans int")
    assert [tuple(r) for r in secret_scan.redact(df).orderBy("doc_id").collect()] == [(1, "x [SECRET] y", "own", 7), (2, None, None, None)]
    text = "".join(f"é token={'a' * 6}{k} and {k:030x} " for k in range(1500))
    got = secret_scan.redact(docs(spark, (1, text, "s"))).first()["text"]
    assert got == "".join("é [SECRET] and [SECRET] " for _ in range(1500))
    spans = secret_scan.scan(docs(spark, (1, text, "s")), secret_scan.BASE).select(secret_scan.told(F.col("spans")).alias("t")).first()["t"]
    assert spans == brute_secrets(text)


def test_index_lists_the_trigrams_there(spark):
    grams = ["tok", "oke", "ken", "://", "a.b", "-be"]
    texts = ["TOKEN", "toke", "a://b", "a.b axb", "--begin", "", "tokenoken"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_key long, text string")
    got = {(r["trigram"], k) for r in secret_scan.postings(rows, grams, 2).collect() for k in r["rows"]}
    assert got == {(g, k) for k, t in enumerate(texts) for g in grams if g in t.lower()}


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True
    assert secret_scan.trigram_query("AKIA[A-Z]+") == ("and", frozenset({"aki", "kia"}))
    assert secret_scan.trigram_query("(abc|xyz)[0-9]+") == secret_scan.either("abc", "xyz")


# SimHash


def test_simhash(spark):
    assert xxhash.xxh64_intdigest(b"one two three", 42) == simhash.fingerprint(" One  two\tthree ")
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(10, base, "a"), (7, base + " more", "a"), (30, "something else entirely is said here", "a"), (31, "", "a"), (32, None, "a"), *ODD]
    got = simhash.near_duplicates(docs(spark, *rows)).collect()
    fps = [(r["doc_id"], r["fp"]) for r in got]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i][1] ^ fps[j][1]) & (2**64 - 1)).count("1") <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    assert [r["component_id"] for r in got] == [least.get(root(i)) for i in range(len(fps))]
    left = simhash.deduplicated(docs(spark, *rows))
    assert left.columns == docs(spark, *rows).columns
    assert left.count() == len({root(i) for i in range(len(fps))})
    assert simhash.near_duplicates(docs(spark, *rows).where("false")).count() == 0


def test_balls_find_all_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(6):
            x = c
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    old = simhash.CROWDED, simhash.BUCKET_VARIANTS, simhash.AT_ONCE
    order = sorted(fps)
    near = {(a, b) for a in order for b in order if a < b and bin(a ^ b).count("1") <= 4}
    try:
        simhash.CROWDED, simhash.BUCKET_VARIANTS, simhash.AT_ONCE = 40, 50_000, 20_000
        df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in order], "fp long")
        found = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.links(df).collect()}
    finally:
        simhash.CROWDED, simhash.BUCKET_VARIANTS, simhash.AT_ONCE = old
    assert found <= near

    def classes(pairs):
        up = {x: x for x in order}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in order]

    assert classes(found) == classes(near) and near


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1300)] + [(random.randint(2000, 2400), random.randint(2000, 2400)) for _ in range(250)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000}
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeats


def brute_repeats(rows):
    seen = {}
    for _, t in rows:
        d = (t or "").encode()
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, f in zip(d, gone, strict=True) if not f)
        out.append((i, len(d), len(d) - len(kept), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [40_000, 400, 1])
def test_repeats(spark, at_once):
    random.seed(1)
    vocabulary = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = [prose(70) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(random.randint(0, 80))]
        for _ in range(random.randint(0, 2)):
            a = random.randint(0, 60)
            parts += [random.choice(shared)[a : a + random.choice([150, 199, 200, 201, 260])], prose(random.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 900), (101, "ab" * 300), (102, "c" * 199), (103, "d" * 200), (104, None), (105, ""), (5, rows[5][1]), (106, rows[7][1] + "x"), (None, "z" * 150 + "y" * 150), (107, "\0" * 400), (108, "q" * 200 + "\0" * 250)]
    df = docs(spark, *[(i, t, "s") for i, t in rows])
    old, repeats.AT_ONCE = repeats.AT_ONCE, at_once
    try:
        assert sorted(map(tuple, repeats.digests(df).collect()), key=str) == brute_repeats(rows)
    finally:
        repeats.AT_ONCE = old
    assert repeats.digests(df.where("false")).count() == 0


def test_removed_bytes(spark):
    rows = repeats.remove(docs(spark, (1, "b" * 300 + "tail", "s"), (2, "short", "s"))).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in rows] == [b"tail", b"short"]
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in rows] == [[(0, 300)], []]


# Lookup sketches


def test_sketch_peels_differences():
    random.seed(6)
    for _ in range(200):
        pool = np.array(random.sample(range(1, 2**48), 60), np.uint64) << np.uint64(16)
        a, b = np.unique(pool[: random.randint(0, 40)]), np.unique(pool[random.randint(0, 30) :])
        plus, minus = lookup_sketch.difference(a, b, 4)
        assert set(plus.tolist()) == set(a.tolist()) - set(b.tolist()) and set(minus.tolist()) == set(b.tolist()) - set(a.tolist())


def multiset(text):
    """The characters of a text's paragraphs, with how often each comes: what a fingerprint stands for."""
    return Counter(lookup_sketch.paragraphs(text))


def plain_likeness(a, b):
    a, b = multiset(a), multiset(b)
    weigh = lambda c: sum(len(p) * n for p, n in c.items())
    total = weigh(a) + weigh(b)
    return 2 * weigh(a & b) / total if total else 1.0


def plain_versions(rows):
    """(doc_id, text) rows in order, each with its edited text and what likenesses there should be."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(plain_likeness(t, new), 9), round(plain_likeness(t, n), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 4, 13])
def test_versions(spark, buckets):
    """Edited texts and both likenesses, against multisets of paragraphs; lines that repeat, long words, retries of tables that did not peel."""
    random.seed(31)
    sentence = lambda: " ".join(random.choice(WORDS) for _ in range(random.randint(1, 18))) + random.choice([".", "!", "\n", " "])
    base = "".join(sentence() for _ in range(60))
    rows = []
    for i in range(60):
        t = random.choice(["", "x", base, base[: random.randint(0, len(base))] + sentence(), "".join(sentence() for _ in range(random.randint(0, 90))), "same line\n" * random.randint(0, 300), "".join(random.choice("天地玄黃宇宙洪荒") for _ in range(3000)), "Q" * 5000])
        rows.append((i * 3 - 40, t))
    got = lookup_sketch.versions(docs(spark, *[(i, t or None, "s") for i, t in rows]), buckets=buckets).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == plain_versions(rows)
    assert all(0.0 <= r["near_edited"] <= 1.0 for r in got)
    assert len({r["fingerprint"] for r in got}) == len({lookup_sketch.sketch(t)[2] for _, t in rows})


def test_long_words_are_cut_by_content():
    random.seed(2)
    word = "".join(random.choice("天地玄黃宇宙洪荒日月盈昃") for _ in range(10_000))
    moved = word[:3000] + "x" + word[3000:]
    assert plain_likeness(word, moved) > 0.9 and "".join(lookup_sketch.paragraphs(word)) == word
    assert 0.6 < plain_likeness(word, lookup_sketch.edited(word, "y" * 5000)) < 0.75
    text = ("b" * 300_000) + " " + word + " short words here"
    assert max(map(len, lookup_sketch.paragraphs(text))) < 0xFFFF and sum(map(len, lookup_sketch.paragraphs(text))) >= 310_000


def test_versions_of_odd_rows(spark):
    assert lookup_sketch.versions(docs(spark, *ODD)).count() == len(ODD)
    assert lookup_sketch.versions(docs(spark, *ODD).where("false")).count() == 0
    alone = lookup_sketch.versions(docs(spark, (1, "a b c. d e f.", "s"))).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 13
    twins = lookup_sketch.versions(docs(spark, (1, "same text here", "s"), (2, "same text here", "s"))).collect()
    assert len({r["fingerprint"] for r in twins}) == 1 and all(r["near_next"] == 1.0 for r in twins)
    assert len(lookup_sketch.keys("a\na\na\nb\n" * 2000)) == 8000


def test_a_frequent_id_is_split(spark):
    """One id, and no id, hold most rows: they are several ranges, and copies of a row come back as often as they are there."""
    rows = [(5, f"text {i} of the one id", "s") for i in range(300)] + [(None, f"no id {i}", "s") for i in range(200)] + [(5, "a copy, many times", "s")] * 50 + [(9, "other", "s")]
    old, lookup_sketch.LISTED = lookup_sketch.LISTED, 16
    try:
        got = lookup_sketch.versions(docs(spark, *rows), buckets=8).collect()
    finally:
        lookup_sketch.LISTED = old
    assert len(got) == len(rows) and sum(r["doc_id"] == 5 for r in got) == 350 and sum(r["doc_id"] is None for r in got) == 200
    copies = [r for r in got if r["n_chars"] == len("a copy, many times")]
    assert len(copies) == 50 and sum(r["near_next"] == 1.0 for r in copies) == 49
    splits = lookup_sketch.boundaries([5, 5, 5, 7], 40, 100, 8)
    assert splits == sorted(splits) and sum(k[0] == 0 and k[1] == -5 for k in splits) == 3 and sum(k[0] for k in splits) == 4


# Nearest neighbours


def brute_lists(x, ids, queries, k=20):
    out = {}
    for q in queries:
        scores = np.array([float((row * x[q]).sum()) for row in x])
        order = [i for i in np.lexsort((ids, -scores)).tolist() if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def lists_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize(("n", "dim"), [(400, 16), (1500, 64)])
def test_neighbours_as_registered(spark, n, dim):
    """Full lists and a recall of 0.9 or more, with the settings that the registered query has."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)).round(3)
    x[50:120] = x[50]  # a vector many rows share
    x *= rng.uniform(0.5, 2.0, size=(n, 1)).round(2) if dim == 16 else 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0] * (dim - 1) + [float("nan")]), (n + 3, [1.0] * (dim - 1) + [None]), (n + 4, [1.0] * 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, bucket string")
    got, want = lists_of(neighbours.search(df, df.where("vec_id % 20 = 0"))), brute_lists(x, np.arange(n), range(0, n, 20))
    assert sorted(got) == sorted(want)
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        assert len(found) == 20 and q not in [v for v, _ in found] and all(abs(s - scores[v]) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("n", [1, 2, 15, 21, 30])
def test_lists_are_full(spark, n):
    """Few vectors: every query gets all others, or 20 of them."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    df = spark.createDataFrame([(i * 5, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists_of(neighbours.search(df, df))
    assert {q: len(f) for q, f in got.items()} == ({i * 5: min(20, n - 1) for i in range(n)} if n > 1 else {})
    # Even where hardly a bucket is visited.
    got = lists_of(neighbours.search(df, df, success=0.01, tables=1, projections=12))
    assert {q: len(f) for q, f in got.items()} == ({i * 5: min(20, n - 1) for i in range(n)} if n > 1 else {})


def test_neighbours_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    # Two rows of one id are two queries, each with the other among its list.
    assert sorted(lists_of(neighbours.search(df, df.where("vec_id = 1")))[1]) == [(1, 1.0), (1, 1.0), (2, 2.0), (2, 2.0), (3, 1.0), (3, 1.0)]
    assert neighbours.search(df.where("false"), df).count() == 0 and neighbours.search(df, df.where("false")).count() == 0


def test_visits_hold_what_they_say():
    """The share of rows at a distance that lie in the cells visited is the success asked for; likelier cells come first."""
    rng = np.random.default_rng(4)
    place, width, distance = rng.uniform(-3, 3, 5), 2.0, 1.1
    cells = [tuple(c.tolist()) for c in neighbours.visits(place, width, distance, 0.6)]
    assert len(set(cells)) == len(cells)
    at = np.floor((place + rng.normal(size=(40_000, 5)) * distance) / width)
    share = [float((at == np.array(c)).all(axis=1).mean()) for c in cells]
    assert 0.58 <= sum(share) and sum(share[:-1]) <= 0.62
    assert all(a >= b - 0.01 for a, b in zip(share, share[1:], strict=False))


# Language


def parted(df, key):
    """Rows to fit on and rows held out."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(2)) == 0), df.where(F.pmod(F.xxhash64(key), F.lit(2)) == 1)


def test_language_of_held_out_texts(spark):
    """Texts alone tell the language: rows held out from the fit, with all other evidence blanked."""
    table = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    seen, held = parted(table, "text")
    model = language_id.fit(seen.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    rows = held.select(F.col("doc_id").alias("id"), "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "host", "domain", "suffix")])
    got = language_id.identify(rows, model).join(held.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    assert len(got) > 50 and sum(r["language"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_language_of_held_out_pages(spark):
    """The same for pages: the language that markup declares is the answer, and is not given as evidence."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    rows = pages.select(F.col("page_id").alias("id"), language_id.visible(F.col("html")).alias("text"), language_id.declared_markup(F.col("html")).alias("label")).where("label is not null")
    seen, held = parted(rows, "text")
    blank = held.select("id", "text", *[F.lit("").alias(c) for c in ("declared", "host", "domain", "suffix")])
    got = language_id.identify(blank, language_id.fit(seen)).join(held, "id").collect()
    assert len(got) > 10 and sum(r["language"] == r["label"] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("heard", [language_id.HEARD, 3.0])
def test_evidence_against_numpy(spark, heard):
    """Every term of the posterior, worked out again in plain loops, for texts short of ``heard`` and beyond it."""
    random.seed(9)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwei drei vier sechs sieben".split()}
    rows = []
    for i in range(120):
        lang = random.choice(["aa", "aa", "bb"])
        text = " ".join(random.choice(words[lang]) for _ in range(random.choice([1, 2, 30, 400]))) if i % 11 else random.choice([None, "", "  "])
        host = random.choice(["a.x.com", "b.x.com", "c.y.org", ""])
        rows.append((i, text, random.choice([lang, lang, "cc", None]), host, host[2:], host.rsplit(".", 1)[-1] if host else "", lang))
    rows += [rows[1], rows[2]]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string, label string")
    model = language_id.fit(df.select("id", "text", "label"))
    got = sorted((r["id"], r["language"], round(r["posterior"], 9), r["kept"]) for r in language_id.identify(df, model, heard=heard).collect())
    n = len(model.languages)
    found = [model.evidence(r[1] or "", heard) for r in rows]
    best = [int(f.argmax()) if (r[1] or "").strip() else None for r, f in zip(rows, found)]
    clean = [tuple(x or "" for x in r[2:6]) for r in rows]  # declared, host, domain, suffix

    def counts(test):
        return np.array([sum(b == k and test(c) for b, c in zip(best, clean)) for k in range(n)], float)

    def smooth(own, above):
        return (own + language_id.STRENGTH * above) / (own.sum() + language_id.STRENGTH)

    total = counts(lambda c: True)
    overall = (total + 1) / (total.sum() + n)
    want = []
    for r, f, c in zip(rows, found, clean):
        known = any(b is not None and d[1:] == c[1:] for b, d in zip(best, clean))
        prior = overall
        if known:
            for test in (lambda d: d[3] == c[3], lambda d: d[2:] == c[2:], lambda d: d[1:] == c[1:]):
                prior = smooth(counts(test), prior)
        score = f + np.log(prior)
        for at in (0, 3):
            own = counts(lambda d: d[at] == c[at])
            if c[at] and own.sum():
                score = score + np.log((own + language_id.STRENGTH * own.sum() / total.sum()) / (total + language_id.STRENGTH))
        k = int(score.argmax())
        posterior = 1 / np.exp(score - score[k]).sum()
        want.append((r[0], model.languages[k], round(float(posterior), 9), model.languages[k] != "und" and posterior >= 0.5))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)]
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, sorted(want), strict=True))


def test_language_of_odd_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    random.seed(3)
    noise = ["".join(chr(random.randint(0x21, 0x7E)) for _ in range(600)), "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(300))]
    df = table.unionByName(spark.createDataFrame([(10**6 + k, t, None, None, None) for k, t in enumerate([*noise, None, ""])], table.schema))
    kept = {r["doc_id"] for r in language_id.kept_documents(df).select("doc_id").collect()}
    assert not kept & {10**6, 10**6 + 1} and len(kept) >= table.count()
    assert language_id.of_documents(table.where("false")).count() == 0
    clash = table.limit(20).withColumn("best", F.lit("x")).withColumn("evidence", F.lit(1)).withColumn("_row", F.lit(2))
    assert language_id.kept_documents(clash).columns == clash.columns
    twice = table.limit(5).unionByName(table.limit(5))
    assert language_id.of_documents(twice).count() == 10


def test_visible_text_of_broken_pages(spark):
    pages = ["<p>a</p><script>var x = '<p>no</p>'", "<nav><a>m</a></nav>b<footer>f</footer>", "<nav><a>m</a><main>c</main>", "<!-- never closed <p>d", "e<style>p{}</style >f", "<nav>" * 20_000 + "g", None]
    got = [r["t"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string").orderBy("i").select(language_id.visible(F.col("html")).alias("t")).collect()]
    assert [" ".join(t.split()) for t in got] == ["a", "b", "m c", "", "e f", "g", ""]


# Pages


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("<p>a<br>b", "a b"), ("plain &amp; text", "plain & text"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T&eacute;st</h1><p>Some prose,  with commas, long enough to count.<p>More prose, it is, for a test.</article><footer>&copy; us</footer>", "Tést\n\nSome prose, with commas, long enough to count.\n\nMore prose, it is, for a test."),
        ("<script>var a='</p><p>no'</script><div class=ad><p>Buy, buy, buy, this is a great product.</p></div><div><p>The real text, with commas, is here, and long.</p></div>", "The real text, with commas, is here, and long."),
        ("<article><p>A long paragraph, with commas, of the article.</p><div class='comments'><p>I, a reader, comment, at length, with commas.</p></div></article>", "A long paragraph, with commas, of the article."),
    ],
)
def test_pages(source, want):
    assert page_text.main_text(source) == want


WORDS = "stone river house evening letter garden window silver matter people because through without morning".split()


def page(draw):
    """A page made of parts, and the text of its article: what an extractor without errors gives."""
    sentence = lambda low, high: " ".join(draw.choice(WORDS) for _ in range(draw.randint(low, high))).capitalize() + draw.choice([".", ", and so on.", "; yes, indeed."])
    prose = lambda: " ".join(sentence(8, 25) for _ in range(draw.randint(2, 5)))
    mark = lambda t: re.sub(r" (\w+) ", lambda m: draw.choice([m[0], m[0], f" <b>{m[1]}</b> ", f" <a href='/x'>{m[1]}</a>\n ", f" {m[1]}&#32; "]), t, count=2)
    flat = lambda t: " ".join(t.split())
    body, want = [], []

    def add(html, *texts):
        body.append(html)
        want.extend(texts)

    title = sentence(3, 6)
    add(f"<h1>{title}</h1>", title)
    for _ in range(draw.randint(3, 9)):
        kind = draw.randrange(9)
        if kind <= 3:
            t = prose()
            add(f"<p>{mark(t)}" + draw.choice(["</p>", ""]), t)
        elif kind == 4:
            h, t = sentence(2, 4), prose()
            add(f"<h2 class='heading'>{h}</h2><p>{mark(t)}</p>", h, t)
        elif kind == 5:
            items = [sentence(2, 9) for _ in range(draw.randint(2, 5))]
            add("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", *items)
        elif kind == 6:
            code = "x = 1;  y = 2"
            add(f"<pre>{code}</pre>", flat(code))
        elif kind == 7:
            t = prose()
            add(f"<blockquote class='related'><p>{t}</p></blockquote>", t)
        else:
            t = prose()
            add(f"<p class='notice-period'>{t}</p>", t)
        noise = draw.randrange(6)
        if noise == 0:
            body.append(f"<div class='ad-box'><p>{prose()}</p></div>")
        elif noise == 1:
            body.append(f"<script>if (a < b) document.write('<p>{prose()}</p>')</script>")
        elif noise == 2:
            body.append(f"<div class='related'><a href='/1'>{sentence(3, 6)}</a> <a href='/2'>{sentence(3, 6)}</a></div>")
    comments = f"<div id='comments'><h3>Comments</h3><p>{prose()}</p><p>{prose()}</p></div>"
    menu = "<nav><ul>" + "".join(f"<li><a href='/{w}'>{w}</a>" for w in WORDS[:6]) + "</ul></nav>"
    chrome = f"<form><label>Search</label><input name=q></form><aside><p>{prose()}</p></aside><div class='cookie-notice'>{prose()}</div>"
    wrap = draw.randrange(3)
    inner = "".join(body)
    article = [f"<article>{inner}{comments}</article>", f"<main><div>{inner}</div>{comments}</main>", f"<div class='content'>{inner}</div>{comments}"][wrap]
    html = f"<!DOCTYPE html><html lang=en><head><title>{title} - site</title><style>p {{ margin: 0 }}</style></head><body><header><h2>The site</h2>{menu}</header>{chrome}{article}<footer><p>&copy; {prose()}</p></footer></body></html>"
    return html, "\n\n".join(flat(w) for w in want)


def test_generated_pages():
    """Articles of known parts, in three kinds of container, among what is no article: exactly the articles come back."""
    draw = random.Random(21)
    for k in range(400):
        html, want = page(draw)
        assert page_text.main_text(html) == want, (k, html)


def test_articles_without_an_element():
    """Headings, lists, code and short paragraphs beside the best container stay."""
    story = "<div class=story>" + "<p>Some prose, with commas, that is long enough to count, and then some more of it.</p>" * 3 + "</div>"
    got = page_text.main_text(f"<div><h1>Title</h1>{story}<h2>Second part</h2><pre>code  x</pre><ol><li>one<li>two</ol><p>Short end with <a href=x>link</a>.</p></div><div class=footer>No</div>")
    assert got.split("\n\n")[0] == "Title" and got.split("\n\n")[4:] == ["Second part", "code x", "one", "two", "Short end with link."]
    assert page_text.main_text(f"<div id=page><h1>Title</h1><div class=body><div class=inner>{story}</div></div><ul><li><a href=1>Tag</a></ul></div>").split("\n\n")[0] == "Title"


def test_broken_quotes_leave_no_markup():
    for source in ('<p>Prose with a <a href="x>link</a> in it, and more, and more.</p><p>Then <a href="/y">another</a>, here.</p>', "<p title='a>Some prose, long enough, to be counted.</p>", '<p a="1"b="2">Some prose, long enough, to be counted.</p>', '<img alt="a > b"><p>Some prose, long enough, to be counted.</p>'):
        assert not re.search(r"[<>=]", page_text.main_text(source)) and "rose" in page_text.main_text(source)


def test_time_is_in_proportion():
    """Deep nesting, many open tags and many stray end tags do not make a page slow."""
    for source in ("<div>" * 4000 + "".join(f"<p>Para {i}, with commas, and text enough.</p>" for i in range(3000)), "<b>" * 6000 + "</i>" * 6000 + "<p>x" * 4000, "<main>" * 4000 + "<p>Text, that is long enough.</p>", '<a href="x' * 4000, "<li>" * 6000, "<script>" + "<" * 200_000):
        begun = time.process_time()
        page_text.main_text(source)
        assert time.process_time() - begun < 4


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", "<p>x</p>", 3), (1, "u", "<p>x</p>", 3), (None, None, "<div>" * 3000 + "y", 3), (5, "v", "<p>" + "word " * 200_000 + "</p>", 4)], "page_id long, url string, html string, text int")
    got = sorted(page_text.extract(df).select("text", "n_chars").collect(), key=lambda r: r["n_chars"])
    assert [r["text"] for r in got[:4]] == ["", "x", "y", "x"] or sorted(r["text"] for r in got[:4]) == ["", "x", "x", "y"]
    assert got[4]["n_chars"] == 5 * 200_000 - 1
    assert page_text.extract(df.where("false")).count() == 0


# Chat


def test_templates():
    text, spans = chat.render(chat.CHATML, [{"role": "user", "text": "<|im_end|> \\"}, {"role": "assistant", "text": "a<|b"}, {"role": "x\ny", "text": ""}])
    assert chat.read_back(text) == [("user", "<|im_end|> \\"), ("assistant", "a<|b"), ("x\ny", "")]
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["a<|b"]
    assert chat.render("{% set x = 1 + 2 %}{% if x == 3 and not none %}{{ x ~ 'a' | upper }}{% elif true %}no{% else %}no{% endif %}{# note #}", [])[0] == "3A"
    assert chat.render("{% for m in messages %}{{ m.text }}{% if not loop.last %}, {% endif %}{% endfor %}", [{"text": "a"}, {"text": "b"}])[0] == "a, b"
    assert chat.folded(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}c{% else %}d{% endif %}")) == [("text", "ab1d")]
    for bad in ("{% for %}", "{{ a.b( }}", "{% if x %}", "{{ x | eval }}", "{% include 'x' %}", "{{ messages.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.render("{{ messages.append }}{{ messages['append'] }}", [])[0] == ""
    assert chat.render("{% for m in messages %}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}", [{"text": "a"}, None, {"text": "b"}, None])[0] == "a,,b,"
    for bad in ("{{ 5 | length }}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ " + "not " * 3000 + "1 }}", "{{ 1" + " + 1" * 3000 + " }}", "{% if 1 %}" * 3000 + "{% endif %}" * 3000, "{{ a" + "[b" * 3000 + " }}", "{% for x in 5 %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.render(bad, [])


def test_chat_frame(spark):
    df = spark.createDataFrame([(1, 0, "user", None, 1), (1, 1, "assistant", "hi", 1), (1, 1, "assistant", "hi", 1), (None, None, None, "t", 1), (2, 0, "user", "x" * 100_000, 1)], "conv_id long, turn long, role string, text string, piece int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"hihi").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nhi\nassistant\nhi\n").hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# Pipeline


def word_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts):
    """The least id of each text's group, by comparing all pairs."""
    sets, up = {i: word_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def plain_copies(rows):
    """How often the mix takes each document: the systematic sampling in plain loops. ``rows``: (doc_id, text, source)."""
    told = []
    for i, t, s in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        bits = size.bit_length() or 1
        h = hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        told.append((s, bits * 16 + (size >> max(bits - 4, 0)), h[:2], size, h, i))
    sources = sorted({r[0] for r in told})
    sizes = {s: sum(r[3] for r in told if r[0] == s) for s in sources}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sources)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    out = {}
    for s in sources:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"1:s{s}".encode()).hexdigest()[:4], 16) / 65536
        for at, r in enumerate(sorted(r for r in told if r[0] == s), 1):
            out[r[5]] = max(math.floor(rate), min(math.floor(u + rate * at) - math.floor(u + rate * (at - 1)), math.ceil(rate)))
    return out


def test_pipeline(spark):
    """All stages against plain code: no document of a known language goes, groups by all pairs, patterns, sampling and the tokenizer library."""
    import base64

    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    rows = {r["doc_id"]: r for r in table.collect()}
    groups = near_groups({i: r["text"] for i, r in rows.items()})  # all are prose in known languages
    left = [i for i in rows if groups[i] == i]
    clean = {}
    for i in left:
        t, at, out = rows[i]["text"], 0, []
        spans = sorted({(m.start(), m.end()) for r in secret_scan.TAKEN_OUT for m in re.finditer(r.regex, t, re.I | re.A if r.any_case else re.A) if len(m[r.value]) >= r.least})
        for s, e in spans:
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        clean[i] = "".join([*out, t[at:]])
    copies = plain_copies([(i, clean[i], rows[i]["source"]) for i in left])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i in left:
        ids = library.encode_ordinary(clean[i])
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(clean[i].encode()).hexdigest())] * copies[i]
    assert got == sorted(want)


def test_stages_on_odd_rows(spark):
    """Each stage by itself: null and empty texts, repeated rows, rows without an id, own columns of any name, an empty table."""
    import corpus_pipeline

    rows = [(i, t, "en", s, None, "own", 3, "k") for i, t, s in ODD] + [(9, "token = abcdefgh and some text of the usual kind", "en", "a", 5, None, None, None)] * 3
    df = spark.createDataFrame(rows, DOCS.replace("spans string", "_spans string").replace("ids int", "_copies int"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, ""), stage(spark, df.where("false"), "")
        assert none.count() == 0
        if name != "byte_bpe":
            assert out.columns == df.columns and none.columns == df.columns and out.count() > 0
            assert {r["_spans"] for r in out.collect()} <= {"own", None}
        else:
            assert out.count() == len(rows)


def test_pipeline_dedups_by_likeness(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(300)]
    edited = [w if k % 60 else "edited" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:150])), (4, " ".join(words)), (5, ""), (6, None), (7, "two words"), (8, "two words"), (9, "two other")]
    table = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    assert len(sets[1] & sets[2]) / len(sets[1] | sets[2]) >= 0.8 and (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 4
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()) == [1, 3, 5, 7, 9]
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r["doc_id"]: similar.shingles(r["text"]) for r in docs_.collect()}
    up = {i: i for i in of}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in of:
        for b in of:
            if a < b and similar.likeness(of[a], of[b]) >= 0.8:
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_, "").collect()) == sorted(i for i in of if root(i) == i)


def test_rare_languages_stay(spark):
    random.seed(8)
    prose = lambda words: " ".join(random.choice(words) for _ in range(60))
    common, rare = "the house of many small rivers and stones".split(), "qazu wexol zymtek oqivu plozz ruvix".split()
    rows = [(i, prose(common), "en") for i in range(1500)] + [(2000 + i, "one copied text of the house", "en") for i in range(1500)] + [(5000 + i, prose(rare), "zz") for i in range(6)] + [(6000, prose(rare), "xx")]
    model = language_id.fit(spark.createDataFrame(rows, "id long, text string, label string"), 100)
    assert model.languages == ["en", "xx", "zz", "und"]  # one row makes a language as well
    assert model.languages[int(model.evidence(prose(rare)).argmax())] in ("xx", "zz") and model.languages[int(model.evidence(prose(common)).argmax())] == "en"


def test_whole_keys_are_redacted(spark):
    line, head, tail = "MIIEow+/" * 8, "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    cases = [
        (f"a {head}\n{line}\n{line}\nabcd==\n{tail} b", "a [SECRET] b"),
        (f"a {head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A\n\n{line}\n{tail}\nb", "a [SECRET]\nb"),
        (f"{head} {line} {line} xY9= then prose goes on", "[SECRET] then prose goes on"),
        (f"{head}\n{line}\n\nprose goes on\n{head}\n{line}\n{tail}", "[SECRET]\n\nprose goes on\n[SECRET]"),
        (f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A\n\n{line}\nxY9=\n\nprose", "[SECRET]\n\nprose"),
        (f"{head}\\n{line}\\n{tail}\\n rest", "[SECRET]\\n rest"),
        (f"{head} is how a key begins - here - and " + "so on - " * 20_000, "[SECRET] is how a key begins - here - and " + "so on - " * 20_000),
        (f"{head}\n" + f"{line}\n" * 3000 + tail, "[SECRET]"),
    ]
    got = secret_scan.redact(docs(spark, *[(i, t, "s") for i, (t, _) in enumerate(cases)])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [want for _, want in cases]


def test_articles_are_kept_whole():
    long = "<p>" + "A sentence, with commas, of the article, that goes on for a while, and then some more, until it is long. " * 3 + "</p>"
    parts = page_text.main_text(f"<body><article><h1>Title</h1><section>{long * 20}</section><section><p>A short end, of two parts.</p></section><ul><li>one</li></ul><div class=share>Share</div></article></body>").split("\n\n")
    assert (parts[0], len(parts), parts[-2:]) == ("Title", 23, ["A short end, of two parts.", "one"])
    assert page_text.main_text(f"<article><h1>Title</h1><div class=entry-content>{long * 3}</div></article>").startswith("Title\n\nA sentence")
    assert page_text.main_text(f"<main><h1>Title</h1><article>{long * 3}</article><aside>x</aside></main><div><p>Other text, beside, of the site.</p></div>").startswith("Title\n\nA sentence")
    two = page_text.main_text(f"<main><article><h2>A</h2><div>{long * 9}</div></article><article><h2>B</h2><p>Another one, of its own.</p></article></main>")
    assert two.startswith("A\n\n") and "B" not in two.split("\n\n")


def test_pages_of_the_driver():
    """The driver's pages, whose articles can be cut out by a pattern: exactly those come back."""
    import html

    pages = duckdb.sql(f"select html from read_parquet('{SF}/pages.parquet') where html is not null").fetchall()
    assert len(pages) > 20
    for (source,) in pages:
        inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert page_text.main_text(source) == "\n\n".join(t for x in parts if (t := " ".join(x.split())))
