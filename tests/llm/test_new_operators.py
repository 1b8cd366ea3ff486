"""Turn repair, class-based language models and ranked search: brute force, odd rows, skew."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import class_lm, queries, ranked, turn_repair
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, piece string, seq int"
DOCS = "doc_id long, text string, lang string, n long, terms string, words int, train string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], TURNS)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "own", 2, "own") for i, t in rows], DOCS)


# Turn repair


def cheapest(rows):
    """Least cost and least edits of ordered (role, text), found by search over all edits."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    seen, faults = set(), []
    for role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("go" if not t or (role, text) in seen else "" if t[-1] in ".!?" else "short")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, out
        if (i, state) in done:
            continue
        done.add((i, state))
        full = {"u": "user", "a": "assistant"}[due[state]]
        heapq.heappush(queue, (cost + 2, edits + "I", i, due[state], (*out, f"{full}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, state, out))
            if faults[i] != "go":
                extra = faults[i] == "short"
                heapq.heappush(queue, (cost + 2 + extra, edits + "R", i + 1, due[state], (*out, f"{full}:{text}")))
                if role[:1] == due[state] or role[:1] == "s" and not state:
                    heapq.heappush(queue, (cost + extra, edits + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    raise AssertionError


def some_turns(n, seed, most=9):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umbrella"], ["a.", "b!", "c", "", " \t", None, "d?  ", "é…", "a.\n"]
    out = []
    for c in range(n):
        for _ in range(rng.randint(1, most)):
            out.append((c if c else None, rng.choice([None, *range(6)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts)))
    return out


def expected_repairs(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, group in by.items():
        group.sort()
        cost, audit, fixed = cheapest([(r, x) for *_, r, x in group])
        numbers = {t for there, t, *_ in group if there}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:], strict=False))
        out[c] = (gaps, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


@pytest.mark.parametrize("long", [20_000, 3])
def test_repairs_are_the_cheapest(spark, monkeypatch, long):
    """Whole conversations at once, and conversations in stretches, against a search over all edits."""
    monkeypatch.setattr(turn_repair, "LONG", long)
    rows = some_turns(250, 3)
    got = turn_repair.digests(turn_repair.repair(turns(spark, rows))).collect()
    assert {r["conv_id"]: (r["gaps"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got} == expected_repairs(rows)
    assert len(got) == len({r["conv_id"] for r in got})


def test_repair_of_one_hot_conversation(spark, monkeypatch):
    """A third of all rows, with very many copies of one, in pieces that follow each other."""
    monkeypatch.setattr(turn_repair, "LONG", 200)
    rng = random.Random(5)
    hot = [(7, k // 3, rng.choice(["user", "assistant"]), rng.choice(["x.", f"w {k}", f"w {k}."])) for k in range(600)] + [(7, 1, "user", "x.")] * 200
    rows = hot + some_turns(60, 4)
    out = turn_repair.repair(turns(spark, rows))
    assert {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in turn_repair.digests(out).collect()} == {c: x[2:] for c, x in expected_repairs(rows).items()}


def test_repair_of_nothing(spark):
    df = turns(spark, [(1, 1, "user", "a.")])
    assert turn_repair.repair(df.where("false")).count() == 0
    gone = spark.createDataFrame([(1, 2, "user", "a.", True), (None, None, None, None, True)], "conv_id long, turn long, role string, text string, gone boolean")
    got = sorted(map(tuple, turn_repair.digests(turn_repair.repair(gone)).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, 0, 0, 0, 0, 0, 0, "", none), (None, 0, 0, 0, 0, 0, 0, "", none)], key=str)


def test_stretches_agree_with_the_whole():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 77, 500):
        codes = rng.integers(0, 4, n).astype(np.uint8) | rng.choice([0, 0, 0, 4, 8], n).astype(np.uint8)
        assert turn_repair.solved_long(codes) == turn_repair.solved([codes])[0]


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"q{t}. r!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = Counter(map(tuple, queries.damaged(turns(spark, rows)).collect()))
    want = Counter()
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        want[(c, t, "user" if k == 4 else role, text, k == 0)] += 1 + (k == 3)
    assert got == want


# Class-based language model


def brute_scores(rows, words, classes):
    """The scores of (doc_id, train, text), given each known word's class, with plain loops."""
    kind, counts = {w: k for w, k, _ in words}, {w: c for w, _, c in words}
    known, types = sum(counts.values()), len(counts)
    per, size, pairs = Counter(), Counter(), Counter()
    for w, c in counts.items():
        per[kind[w]] += c
        size[kind[w]] += 1
    toks = lambda t: [w.decode() for w in class_lm.tokens(t)]
    for _, train, text in rows:
        if train:
            line = ["", *toks(text)]
            pairs.update((kind[a], kind[b]) for a, b in zip(line, line[1:], strict=False))
    unknown = 0.1 / (known + 0.1 * types + 0.1)
    share = {k: (per[k] + 0.1 * size[k]) / (known + 0.1 * types) for k in range(classes)}

    def after(a, b):
        if b is None:
            return unknown
        if a is None:
            return (1 - unknown) * share[b]
        return (1 - unknown) * (pairs[a, b] + class_lm.SHARES * share[b]) / (per[a] + class_lm.SHARES)

    out = {}
    for doc_id, _, text in rows:
        line = toks(text)
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (known + 0.1 * (types + 1))) for w in line)
        score = 0.0
        for a, b in zip(["", *line], line, strict=False):
            k = kind.get(b)
            score += math.log10(after(0 if not a else kind.get(a), k)) + (math.log10((counts[b] + 0.1) / (per[k] + 0.1 * size[k])) if k is not None else 0)
        out[doc_id] = (len(line), sum(w in counts for w in line), base, score)
    for a in [None, 0, 1]:
        if a is None or per[a]:
            assert abs(sum(after(a, b) for b in [None, *range(classes)]) - 1) < 1e-9
    return out


def test_class_scores_against_loops(spark, monkeypatch):
    """Several blocks and buckets; the model's own classes give the same scores in plain loops."""
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(class_lm, "BUCKET_BYTES", 4000)
    rng = random.Random(2)
    rows = []
    for i in range(300):
        kind = i % 2
        rows.append((i, i % 10 != 3, " ".join(rng.choice(["ab", "Cd", "ef\tGH"][kind:] + [f"{'xy'[kind]}{rng.randint(0, 400 if i < 280 else 900)}"]) for _ in range(rng.randint(0, 30)))))
    df = spark.createDataFrame(rows, "doc_id long, train boolean, text string")
    model = class_lm.fit(df.repartition(3), 6, 8)
    words = [tuple(r) for r in model.words().collect()]
    want = Counter(w.decode() for _, train, text in rows if train for w in class_lm.tokens(text))
    assert {w: c for w, _, c in words} == dict(want) and {k for w, k, _ in words if w == ""} == {0} and all((k == 0) == (w == "") for w, k, _ in words)
    assert model.n_tokens == sum(want.values()) and model.types.sum() == len(want)
    expected = brute_scores(rows, words, 8)
    for r in class_lm.scored(model).collect():
        n, known, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6


def test_exchange_finds_the_classes(spark):
    """Words of two kinds that alternate end in classes that tell them apart, and unseen texts are likelier for it."""
    rng = random.Random(4)
    left, right = [f"l{k}" for k in range(30)], [f"r{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice((left, right)[k % 2]) for k in range(20))) for i in range(600)]
    got = class_lm.scores(docs(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 0}
    n = sum(r["n_tokens"] for r in held)
    assert (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / n > 0.9 * math.log10(2)


def test_class_scores_beat_the_base_on_held_out_rows(spark):
    got = queries.op12_class_lm(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_scores_of_odd_rows(spark):
    rows = [(1, "One two"), (1, "One two"), (None, None), (2, ""), (3, "é " * 30_000), (4, None), (10, "never seen")]
    got = class_lm.scores(docs(spark, rows)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 3, 3, 3, 30_001]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert class_lm.scores(docs(spark, rows).where("false")).count() == 0
    alone = [r for r in range(100) if zlib.crc32(str(r).encode()) % 10 == 0][:3]
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in class_lm.scores(docs(spark, [(i, "a b") for i in alone])).collect()] == [(0, 0, 0.0, 0.0)] * 3


# Ranked search


def brute_ranking(rows, items, k=20):
    texts = [(i, ranked.terms(t)) for i, t in rows]
    texts = [(i, t, Counter(t)) for i, t in texts if t]
    n_docs, n_words = len(texts), sum(len(t) for _, t, _ in texts)
    df = Counter(w for _, t, _ in texts for w in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(ranked.terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc_id, t, tf in texts:
            m = 75 + 25 * len(t) * n_docs // n_words
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w, r in wanted.items() if tf[w])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("postings", "items"), [(1_000_000, 4000), (300, 3)])
def test_ranking_against_all_scores(spark, monkeypatch, postings, items):
    """One shard and many, one block of items and several; ties, repeats, nulls and clashing names."""
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked, "ITEMS", items)
    rng = random.Random(6)
    words = ["the", "The", "of", "é", "ÀB", "x-y", "a1", "b c", "--", *[f"w{k}" for k in range(60)]]
    weight = [30, 5, 20, *[3] * 6, *[1] * 60]
    rows = [(i % 400, " ".join(rng.choices(words, weight, k=rng.randint(0, 40)))) for i in range(500)] + [(None, "the w1 w2"), (9000, None), (9001, ""), (9002, "the " * 5000), *[(9100 + k, "w3 w4") for k in range(40)]]
    asked = [(i, " ".join(rng.choices(words, weight, k=rng.randint(0, 12)))) for i in range(12)] + [(0, "w3 w3"), (None, "w4"), (77, None), (78, "nowhere")]
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in asked], "item_id long, text string, score string, rank int")
    got = ranked.search(docs(spark, rows).repartition(3), df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(rows, asked)


def test_ranking_of_nothing(spark):
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(docs(spark, [(1, "a")]).where("false"), item).count() == 0
    assert ranked.search(docs(spark, [(1, "a")]), item.where("false")).count() == 0


def test_ranking_stops_before_the_end_of_the_postings():
    """A rare term settles the best documents, so the postings of common terms are not all read."""
    rng = np.random.default_rng(3)
    n = 20_000
    rows = [(d, 0, 1 + int(rng.integers(3))) for d in range(n)] + [(d, 1, 400) for d in range(0, n, n // 25)][:20]
    rows.sort()
    owner, term, tf = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    weight = ranked.weights(np.array([n // 2, 20]), n)
    shard = ranked.Shard(np.full(n, 30), owner, term, tf, weight, n, 30 * n)
    best, scores = shard.best({0: 1, 1: 3}, 20, 0)
    assert shard.read < shard.all / 2
    plain = np.zeros(n, np.int64)
    np.add.at(plain, owner, np.where(term == 1, 3, 1) * (weight[term] * ((10**9 * tf) // (1000 * tf + 12 * (75 + 25)))))
    assert set(best.tolist()) == set(np.argsort(-plain)[:20].tolist()) and (plain[best] == scores).all()
