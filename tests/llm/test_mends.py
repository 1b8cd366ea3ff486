"""Cases that once went wrong: rare labels, long secrets, class names in camel case, adversarial markup, many queries of one part."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import language_id, neighbours, page_text, secret_scan, similar
from tests.llm.test_operators import WORDS, brute_lists, docs, lists_of, page


def test_a_label_of_one_row_is_a_language(spark):
    """Its document is told by it and kept, among many of other labels, in the operator and in the pipeline's stage."""
    rng = random.Random(1)
    some = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(80))
    rows = [(i, some(("abcdefg", "mnopqrs")[i % 2]), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(60)] + [(99, some("uvwxyz"), "xx", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["language"], r["kept"]) for r in language_id.of_documents(df).collect()}
    assert got[99] == ("xx", True) and all(got[i] == (("en", "fr")[i % 2], True) for i in range(60))
    assert corpus_pipeline.language(spark, df, "").where("doc_id = 99").count() == 1


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LABELS", 3)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}", "s") for i in range(4)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="4 labels"):
        language_id.of_documents(df)


def test_a_key_with_many_dashes_goes_whole(spark):
    head, tail = "-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"before {head}{'ab-cd-' * 50}{tail} after", "s"), (2, f"x {head}{'-a' * 30_000}{tail} y", "s"), (3, f"{head}{'k' * 64} {head}{'ab-' * 200}{tail}.", "s")]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, *rows)).collect()}
    assert got[1] == "before [SECRET] after" and got[2] == "x [SECRET] y"
    assert got[3].endswith("[SECRET].") and "ab-" not in got[3]


def test_long_tokens_go_whole(spark):
    secrets = ["ghp_" + "a1B" * 140, "xoxb-" + "9z-" * 140, "sk_live_" + "Ab3" * 140]
    rows = [(i, f"see {s} end", "s") for i, s in enumerate(secrets)]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, *rows)).collect()}
    assert got == {i: "see [SECRET] end" for i in range(3)}
    spans = secret_scan.scan(docs(spark, *rows)).select("doc_id", F.filter("spans", lambda s: s["kind"].isin("github", "slack", "stripe")).alias("s")).collect()
    assert all(r["s"][0]["end"] - r["s"][0]["start"] == len(secrets[r["doc_id"]]) for r in spans)


@pytest.mark.parametrize("name", ["readerComments", "cookieConsent", "siteFooter", "adContainer", "commentsSection", "ReaderComments", "userComments", "ADContainer", "newsletterSignup"])
@pytest.mark.parametrize("attribute", ["class", "id", "role"])
def test_capitals_part_class_words(name, attribute):
    prose = "Some prose, with commas, that is long enough to count, and then some more of it."
    block = f"<div {attribute}='{name}'><p>{prose}</p><p>{prose}</p></div>"
    assert page_text.main_text(f"<body><article><h1>Title</h1><p>{prose}</p><p>{prose}</p>{block}</article>{block}</body>") == f"Title\n\n{prose}\n\n{prose}"
    assert page_text.main_text(f"<body>{block}<div class='articleBody'><h1>Title</h1><p>{prose}</p><p>{prose}</p></div>{block}</body>") == f"Title\n\n{prose}\n\n{prose}"


def camel(source, draw):
    """The same page with its class words in camel case, some as ids or roles, and without quotes."""
    import re

    def changed(m):
        words = m[2].split("-")
        name = words[0] + "".join(w.capitalize() for w in words[1:])
        if m[2] in ("cookie-notice", "ad-box"):
            name = draw.choice([name, "adContainer", "cookieConsent", "newsletterSignup"])
            return f"{draw.choice(['class', 'id', 'role'])}={draw.choice([name, repr(name)])}"
        if m[2] == "comments":
            name = draw.choice(["comments", "readerComments", "commentsSection", "commentList"])
        return f"{m[1]}='{name}'"

    return re.sub(r"(class|id)='([a-z-]+)'", changed, source)


def test_generated_pages_in_camel_case():
    draw = random.Random(22)
    for k in range(300):
        source, want = page(draw)
        source = camel(source, draw)
        assert page_text.main_text(source) == want, (k, source)


def test_articles_side_by_side():
    """Several stories stay; a teaser beside them that scores little goes."""
    draw = random.Random(23)
    story = lambda: "<p>" + " ".join(draw.choice(WORDS) for _ in range(60)) + ", and so on.</p>"
    for _ in range(50):
        parts = [story() * draw.randint(2, 3) for _ in range(draw.randint(2, 4))]
        source = "<main>" + "".join(f"<article class=postItem>{p}</article>" for p in parts) + "<article class=card><a href=x>More</a></article></main>"
        want = [t.removeprefix("<p>") for p in parts for t in p.split("</p>") if t]
        assert page_text.main_text(source).split("\n\n") == want


@pytest.mark.parametrize("unit", ["<![CDATA[>", "<![CDATA[", "<!--", "<div class='", "<a <", "<script>", "<p><", "&#", "<!x", "</p", "<ul><li>", "<![CDATA[]]>"])
def test_time_of_adversarial_markup(unit):
    """A megabyte of any such unit takes a few seconds at most."""
    begun = time.process_time()
    page_text.main_text("<p>Some prose, with commas, of the page.</p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - begun < 8


def test_cdata():
    assert page_text.main_text("<article><p>One, two, three, four, five<![CDATA[ <six> & ]]>seven, of a page.</p></article>") == "One, two, three, four, five <six> & seven, of a page."
    assert page_text.main_text("<article><p>One, two, three, four, five, six<![CDATA[ x > seven, of a page.</p></article>") == "One, two, three, four, five, six seven, of a page."


def test_many_queries_of_one_part(spark, monkeypatch):
    """Few parts and many queries: no task gets more than about so many queries, and lists are those of brute force."""
    monkeypatch.setattr(neighbours, "ASKED", 40)
    ranked = neighbours._ranked

    def watched(dim, k):
        inner = ranked(dim, k)

        def run(left, right):
            if right.num_rows > 100:  # hashes of 40 a set on average
                raise AssertionError(f"{right.num_rows} queries in one group")
            return inner(left, right)

        return run

    monkeypatch.setattr(neighbours, "_ranked", watched)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = lists_of(neighbours.search(df, df)), brute_lists(x, np.arange(900), range(900))
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert len(got) == 900 and np.mean(found) >= 0.9
    few = lists_of(neighbours.search(df, df, success=0.01, tables=1, projections=12))  # most go on to all parts
    assert all(len(v) == 20 for v in few.values())


def test_rows_of_the_ranking_do_not_grow_with_parts(spark, monkeypatch):
    """Many parts: what leaves the ranking is in proportion to the vectors, and lists are as with one part."""
    x = np.random.default_rng(6).normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, lists, made = lists_of(neighbours.search(df, df.where("vec_id % 20 = 0"))), neighbours._lists, []
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "_lists", lambda asked, found, entries, k: made.append(found.count()) or lists(asked, found, entries, k))
    assert lists_of(neighbours.search(df, df.where("vec_id % 20 = 0"))) == want and len(want) == 45
    assert lists_of(neighbours.search(df, df.where("vec_id % 20 = 0"), success=0.01, tables=1, projections=12)).keys() == want.keys()  # most are compared with all
    assert len(made) == 3 and max(made) <= 15 * len(x)


@pytest.mark.parametrize(("n", "success"), [(1, 0.9), (3, 0.3), (4, 0.7), (6, 0.5)])
def test_a_reach_tells_the_cells_visited(n, success):
    """A query's row has one length, whatever it visits, and tells exactly the cells of ``visits``."""
    place = np.random.default_rng(n).uniform(-9, 9, n)
    cells = np.array([c.tolist() for c in neighbours.visits(place, 2.5, 1.2, success)], np.int64)
    grid = np.stack(np.meshgrid(*[np.arange(-4, 5) + int(np.floor(p / 2.5)) for p in place]), -1).reshape(-1, n)
    found = neighbours.reach(place, 2.5, 1.2, success)
    assert len(found) == 1 + n + n * (2 * neighbours.AROUND + 1)
    assert {tuple(c) for c in grid[neighbours.visited(found[None], grid)[0]]} == {tuple(c) for c in cells}


def test_near_texts_of_a_crowded_band_are_found(spark, monkeypatch):
    """Many twins, each near its other only, that share bands with many: found whatever the centres of bands tell."""
    monkeypatch.setattr(similar, "BLOCK_SETS", 12, raising=False)
    monkeypatch.setattr(similar, "stars", lambda rooted, turn: rooted.where("false").select(F.col("same").alias("a"), F.col("same").alias("b")))
    rng = random.Random(5)
    base = [f"w{k}" for k in range(1600)]

    def edited(words, times):
        out = list(words)
        for at in rng.sample(range(320), times):
            out[5 * at] = f"v{at}"  # others have it too, so no band is of two twins alone
        return out

    texts = []
    for _ in range(60):
        one = edited(base, 30)
        texts += [one, edited(one, 34)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [similar.shingles(t) for _, t in rows]
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar.likeness(sets[i], sets[j]) >= similar.LEAST}
    assert sum((2 * f, 2 * f + 1) in near for f in range(60)) > 50
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in near:
        up[max(root(i), root(j))] = min(root(i), root(j))
    want = {i for i in range(len(sets)) if root(i) == i}
    assert 50 < len(want) < 70
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.deduplicated(table).collect()} == want
