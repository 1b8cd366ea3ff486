"""Hand-written cases of rule matching, and the matcher against brute force."""

from __future__ import annotations

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from plumbline.operators import match, repair, resolve
from plumbline.sources import rules as lists

#: Patterns with look-ahead and with alternatives inside, for other turns of phrase.
PATTERNS = (r"\bon\s+the\s+(?=one|other)\w+\s+hand\b", r"\beither\b(?![^.;]*\bnor\b)[^.;]{1,40}\bor\b", r"[(]a[)]|\[b\]")


def first(spark, expression, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", expression).orderBy("id").collect()
    return [None if r["h"] is None else (r["h"]["start"], r["h"]["rule"]) for r in rows]


@pytest.mark.parametrize(
    ("text", "phrases", "want"),
    [
        ("cation", ["cat"], None), ("cat[morecat]", ["cat"], (0, "cat")), ("cat[morecat]", ["cat["], (0, "cat[")), ("cat sat", ["cat", "cat sat"], (0, "cat")),
        ("the cat", ["cat"], (4, "cat")), ("cat_x", ["cat"], (0, "cat")), ("😀 a Cat.", ["cat"], (4, "cat")), ("", ["cat"], None), (None, ["cat"], None), ("scatter cat", ["cat"], (8, "cat")),
    ],
)
def test_phrases(spark, text, phrases, want):
    assert first(spark, match.phrase_first(F.col("text"), match.Rules(tuple(phrases))), text) == [want]


def test_longest_tie(spark):
    assert first(spark, match.phrase_first(F.col("text"), match.Rules(("cat", "cat sat"), tie="longest")), "a cat sat") == [(2, "cat sat")]


def test_regexes(spark):
    rules = match.Rules(regexes=PATTERNS)
    got = first(spark, match.regex_first(F.col("text"), rules), "😀 and then, on the other hand", "It is either this\nor that on the one hand", "either nor or", "see [b]", "see (a)", None)
    assert got == [(12, PATTERNS[0]), (6, PATTERNS[1]), None, (4, PATTERNS[2]), (4, PATTERNS[2]), None]
    with pytest.raises(ValueError):
        match.regex_pattern([r"(a)\1"])


def test_groups_and_invalid_patterns(spark):
    """Parentheses in character classes are no groups; a pattern that does not compile is left out, and the others keep their numbers."""
    rules = match.Rules(regexes=(r"[(]a", "(unclosed", r"(x)(?:y)(?P<n>z)", r"q"))
    assert [k for k, _ in match.valid(rules.regexes)] == [0, 2, 3]
    assert first(spark, match.regex_first(F.col("text"), rules), "a q", "an xyz", "b (a") == [(2, "q"), (3, r"(x)(?:y)(?P<n>z)"), (2, "[(]a")]
    assert first(spark, match.regex_first(F.col("text"), match.Rules(regexes=("(",))), "(") == [None]


def test_patterns_that_run_away(spark):
    rules = match.Rules(regexes=(r"(?:a|a\B|aa)+[^ab ]", r"b\d"))
    rows = spark.createDataFrame([(0, "a" * 60 + "b"), (1, "see b7"), (2, None), (3, "none")], "id long, text string")
    got = match.regex_first_timed(rows, rules, seconds=0.3).orderBy("id").collect()
    assert [(r["timed_out"], r["hit"] and r["hit"]["start"]) for r in got] == [(True, None), (False, 4), (False, None), (False, None)]
    assert got[1]["hit"]["rule"] == r"b\d" and got[1]["hit"]["kind"] == "regex"


def test_offsets_are_those_of_the_text(spark):
    """A letter whose lower case is longer does not move what comes after it."""
    assert first(spark, match.phrase_first(F.col("text"), match.Rules(("cat", "İx"))), "İİ the cat", "İ cat", "an İX") == [(7, "cat"), (2, "cat"), (3, "İx")]
    assert first(spark, match.ngram_first(F.col("text"), match.Rules(ngrams=(("deep", "breath"),))), "İİ Deep breath") == [(3, "deep breath")]
    hits = spark.createDataFrame([("İ cat cat",)], "text string").select(match.phrase_all(F.col("text"), match.Rules(("cat",))).alias("h")).first()["h"]
    assert [h["start"] for h in hits] == [2, 6]


def test_many_hits_in_one_text(spark):
    text = "a cat, " * 1500
    hits = spark.createDataFrame([(text,)], "text string").select(match.phrase_all(F.col("text"), match.Rules(("cat",))).alias("h")).first()["h"]
    assert [h["start"] for h in hits] == list(range(2, len(text), 7))


@pytest.mark.parametrize("tie", ["shortest", "longest"])
def test_columns_and_loop_agree(spark, tie):
    """The rules as columns and as the loop's matcher: the same first hit of each kind, on random texts."""
    random.seed(11)
    rules = match.Rules(("b a", "b", "ab c", "é"), (r"a[bc]+\b", r"c{2,}"), (("ab", "c"), ("c", "ab"), ("c", "ab", "é")), tie=tie)
    texts = ["".join(random.choice(["a", "b", "c", " ", " ", "é", "İ", "-", "\n", "ab", " c ", "AB"]) for _ in range(random.randint(0, 14))) for _ in range(800)]
    own = repair.Matcher(rules)
    rows = match.first_hits(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), rules).orderBy("id").collect()
    some = 0
    for r in rows:
        want = {}
        for start, kind, _, length, rule, key in sorted(own.hits(r["text"])):
            want.setdefault(own.kinds[kind], (start, length, rule, key))
        got = {h["kind"]: (h["start"], h["length"], h["rule"], h["detail_key"]) for h in r["hits"]}
        assert got == want, r["text"]
        some += len(want)
    assert some > 400


def test_matching_goes_on_where_a_text_grew():
    """Hits found again only from where a text changed are those that a search of the whole text would find from there on."""
    random.seed(12)
    own = repair.Matcher(match.Rules(("b a", "ab c d"), (), (("ab", "c"), ("d", "ab", "c"))))
    for _ in range(600):
        before = "".join(random.choice(["a", "b", "c", "d", " ", " ", "the ", "-"]) for _ in range(random.randint(0, 60)))
        after = before + "".join(random.choice(["a", "b", "c", "d", " ", "the "]) for _ in range(random.randint(1, 8)))
        known = set(own.hits(before)) - set(own.hits(after))
        new = set(own.hits(after)) - set(own.hits(before))
        assert new <= set(own.hits(after, len(before)))
        assert all(h[0] + h[3] >= len(before) - 1 or h[1] == 2 for h in known)


def test_ngrams(spark):
    assert first(spark, match.ngram_first(F.col("text"), match.Rules(ngrams=(("took", "deep", "breath"),))), "He took a deep breath") == [(3, "took deep breath")]
    kept = match.Rules(ngrams=(("could", "help"), ("could", "help", "feel")), remove_stopwords=False)
    assert first(spark, match.ngram_first(F.col("text"), kept), "could help feel", "could not help") == [(0, "could help feel"), None]


def test_kind_settles_ties(spark):
    rules = match.Rules(("deep breath",), (), (("deep", "breath"),))
    row = match.first_hits(spark.createDataFrame([("a deep breath",)], "text string"), rules).select(resolve.earliest_of().alias("v")).first()["v"]
    assert (row["token"], row["hit"]["kind"]) == (1, "phrase")


def test_brute_force(spark):
    random.seed(3)
    phrases, alphabet = ["a b", "ab", "b-", "-a", "é", "aé b"], "ab é-_1"
    word = lambda c: unicodedata.category(c)[0] in "LNM"

    def slow(t):
        low = t.lower()
        for i in range(len(low)):
            for p in sorted(phrases, key=lambda p: (len(p), p)):
                j = i + len(p)
                if low.startswith(p, i) and not (word(p[0]) and i and word(low[i - 1])) and not (word(p[-1]) and j < len(low) and word(low[j])):
                    return i, p
        return None

    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    want = [slow(t) for t in texts]
    assert sum(w is not None for w in want) > 300
    assert first(spark, match.phrase_first(F.col("text"), match.Rules(tuple(phrases))), *texts) == want


def test_offsets_out_of_range(spark):
    tokens = spark.createDataFrame([(1, 0, "He", 0, 2), (1, 1, " ran", 2, 6), (1, 2, " home", 6, 11)], "doc_id long, pos int, token string, start int, end int")
    got = resolve.tokens_at(spark.createDataFrame([(1, 4), (1, 11), (2, 0)], "doc_id long, offset int"), tokens).collect()
    assert {(r["doc_id"], r["offset"]): r["pos"] for r in got} == {(1, 4): 1, (1, 11): None, (2, 0): None}


def test_suppression(spark):
    rules = match.Rules(("cat",))
    docs = spark.createDataFrame([(1, "cat and cat"), (2, "cat")], "doc_id long, text string")
    hits = resolve.with_tokens(match.all_hits(docs, rules)).select("doc_id", "token", "hit")
    gone = spark.createDataFrame([(1, "phrase", 0, "cat"), (2, "phrase", 0, "cat")], "doc_id long, kind string, token int, detail_key string")
    assert [(r["doc_id"], r["token"]) for r in resolve.earliest(resolve.unsuppressed(hits, gone)).collect()] == [(1, 2)]
    assert resolve.masked(hits, gone).count() == 0


def test_suppression_within_rows(spark):
    rules = match.Rules(("cat",), (), (("big", "cat"),))
    docs = spark.createDataFrame([(1, "cat and big cat"), (2, "cat"), (3, "none"), (4, None)], "doc_id long, text string")
    hits = F.concat(match.phrase_all(F.col("text"), rules), F.transform(match.ngram_hits(F.col("text"), rules), lambda h: match.ngram_of(F.col("text"), h, rules)).cast(f"array<{match.HIT}>"))
    gone = spark.createDataFrame([(1, "phrase", 0, "cat"), (2, "phrase", 0, "cat"), (9, "phrase", 0, "x")], "doc_id long, kind string, token int, detail_key string")
    rows = docs.withColumn("found", resolve.placed(hits, F.col("text"))).join(resolve.suppressed_lists(gone), "doc_id", "left")
    got = {r["doc_id"]: (r["a"] and r["a"]["token"], r["b"] and r["b"]["hit"]["kind"]) for r in rows.select("doc_id", resolve.first_unsuppressed(F.col("found"), F.col("suppressed")).alias("a"), resolve.first_masked(F.col("found"), F.col("suppressed")).alias("b")).collect()}
    assert got == {1: (2, "ngram"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_lists():
    assert lists.phrases([["Cat", 2], ["dog"], ["cat", 3], 5, [7]]) == {"cat": 3.0, "dog": 0.0}
    assert lists.phrases([["a"], ["b"]], 1) == {"a": 0.0}
    assert lists.phrases([["a"]], 0) == {}
    assert lists.regexes(["a", 1]) == ["a"]
    assert lists.ngrams(["Took a deep", ["deep", "breath", "!"], "the", "took deep"]) == [("took", "deep"), ("deep", "breath")]
    assert lists.lengths([("a",), ("a", "b", "c")]) == (1, 3)


def plain_hits(text, phrases, shortest):
    """All leftmost non-overlapping hits by trying each phrase at each place."""
    word, low, out, i = lambda c: unicodedata.category(c)[0] in "LNM", text.lower(), [], 0
    by_length = sorted(set(phrases), key=lambda p: (len(p) if shortest else -len(p), p))
    while i < len(low):
        hit = next((p for p in by_length if low.startswith(p, i) and not (word(p[0]) and i and word(low[i - 1])) and not (word(p[-1]) and i + len(p) < len(low) and word(low[i + len(p)]))), None)
        out += [(i, hit)] if hit else []
        i += len(hit) if hit else 1
    return out


@pytest.mark.parametrize("tie", ["shortest", "longest"])
def test_factored_phrases(spark, tie):
    """Many phrases with common beginnings, odd characters and ends within each other; texts that hold the engine's marks."""
    random.seed(14)
    pieces = ["a", "b", "ab", " ", "-", "é", "1", "\\E", ".", "[", "^", "\n", "q"]
    phrases = sorted({"".join(random.choice(pieces) for _ in range(random.randint(1, 5))) for _ in range(300)})
    phrases = random.sample([p.lower() for p in phrases], 120)
    texts = ["".join(random.choice([*pieces, "A", "\u0001", "\u0002"] if k % 5 == 0 else [*pieces, "B"]) for _ in range(random.randint(0, 30))) for k in range(600)]
    rules = match.Rules(tuple(phrases), tie=tie)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", match.phrase_all(F.col("text"), rules).alias("h"), match.phrase_first(F.col("text"), rules).alias("f")).orderBy("id").collect()
    some = 0
    for r, text in zip(rows, texts, strict=True):
        want = plain_hits(text, phrases, tie == "shortest")
        assert [(h["start"], h["rule"]) for h in r["h"]] == want, text
        assert (r["f"] and (r["f"]["start"], r["f"]["rule"])) == (want[0] if want else None)
        some += len(want)
    assert some > 1000


def test_long_phrase_lists_cost_little_more(spark):
    """2,000 phrases take at most twice the time of five, with the same hits of those five."""
    random.seed(15)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(4).cache()
    words = sorted({w for r in docs.limit(200).collect() for w in r["text"].lower().split() if w.isalpha()})
    few = [" ".join(random.sample(words, 2)) for _ in range(4)] + ["the of"]
    many = few + ["zz" + " ".join(random.sample(words, 2)) for _ in range(1995)]
    took, hits = {}, {}
    for name, phrases in (("few", few), ("many", many)) * 3:
        begun = time.perf_counter()
        found = docs.select("doc_id", F.explode(match.phrase_all(F.col("text"), match.Rules(tuple(phrases)))).alias("h")).select("doc_id", "h.start", "h.rule").collect()
        took[name] = min(took.get(name, 1e9), time.perf_counter() - begun)
        hits[name] = sorted(map(tuple, found))
    docs.unpersist()
    assert hits["few"] == hits["many"]
    assert took["many"] < 2 * took["few"] + 0.5, took


def test_patterns_and_marks(spark):
    """Which pattern it is, and where, also for groups within patterns and in texts that hold the marks."""
    rules = match.Rules(regexes=(r"x(a|b)+", r"(?<!y)c{2}(d)?", r"q(?=r)"))
    texts = ["..xab", "yccc", "é ccd", "qr", "q", "\u0001ccd", "xb\u0002", "\u0002 \u0001 qr", None]
    got = first(spark, match.regex_first(F.col("text"), rules), *texts)
    assert got == [(2, rules.regexes[0]), (2, rules.regexes[1]), (2, rules.regexes[1]), (0, rules.regexes[2]), None, (1, rules.regexes[1]), (0, rules.regexes[0]), (4, rules.regexes[2]), None]
