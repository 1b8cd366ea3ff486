"""Byte-level BPE against the library it must agree with, and round trips."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'l", "l", "'", "é", "😀", "ß", "1", "²", "_", "-", "***", "\t", "\xa0", "\x85", "\x1c", "the", "ing", "THE", "Ω", "中"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_ids_as_library(library, text):
    own = bpe.codec()
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def _forget():
    bpe.codec().cache.clear()
    bpe.codec().earlier.clear()


@pytest.fixture
def leaves():
    """Sets how short what is not halved has to be, and puts that back."""
    was = bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.HEAPED, bpe.DECODE_LEAF

    def put(text, piece, heaped, decode=5):
        bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.HEAPED, bpe.DECODE_LEAF = text, piece, heaped, decode
        _forget()

    yield put
    bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.HEAPED, bpe.DECODE_LEAF = was
    _forget()


SIZES = [(1, 1, 1), (2, 2, 4), (7, 3, 1 << 20), (7, 3, 8), (16, 5, 16), (64, 48, 192)]


@pytest.mark.parametrize("sizes", SIZES)
@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=TEXTS)
def test_same_ids_however_it_is_halved(library, leaves, sizes, text):
    leaves(*sizes)
    own = bpe.codec()
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("sizes", SIZES)
def test_words_made_of_the_vocabulary(library, leaves, sizes):
    """Unbroken words made of the longest tokens, their halves and their overlaps, where seams move furthest."""
    leaves(*sizes)
    own, draw = bpe.codec(), random.Random(7)
    words = [t.decode() for t in own.ranks if len(t) > 5 and t.isalpha() and t.isascii()]
    for _ in range(300):
        parts = [w[draw.randrange(len(w)) :] if draw.random() < 0.4 else w[: draw.randrange(1, len(w) + 1)] for w in draw.choices(words, k=draw.randrange(1, 25))]
        text = "".join(parts)
        assert own.encode(text) == library.encode_ordinary(text)


def test_a_window_as_large_as_the_data_ends(library, leaves):
    """Runs of one letter have seams that move through all of the data."""
    leaves(1 << 16, 3, 192)
    for n in (400, 1_000, 5_000):
        for unit in ("a", "ha", "=", "abcabd"):
            assert bpe.codec().encode(unit * n) == library.encode_ordinary(unit * n)


def test_both_ways_of_merging_agree(leaves):
    own, draw = bpe.codec(), random.Random(3)
    for _ in range(300):
        data = bytes(draw.choice(b"aaabcdeinorst \xc3\xa9") for _ in range(draw.randrange(1, 150)))
        leaves(1 << 16, 48, 1 << 20)
        looked = own.merged(data)
        leaves(1 << 16, 48, 0)
        assert own.merged(data) == looked


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, " " * 50_000 + "x", "é" * 20_000, "x y\n" * 40_000])
def test_long_runs(library, text):
    assert bpe.codec().encode(text) == library.encode_ordinary(text)


def test_frame(spark, library):
    docs = spark.createDataFrame([(1, "Hi there", "own"), (2, None, None), (2, None, None), (3, "", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in rows] == ["Hi there", "", "", ""]
    assert len(rows[0]["ids"]) == 4 * len(library.encode_ordinary("Hi there"))
    assert bpe.encode(docs.where("false")).count() == 0


def test_one_pass_is_encoding_and_then_decoding(spark):
    docs = spark.createDataFrame([(1, "Hi there", "own", 5), (2, None, None, 6), (3, "", "x", 7), (4, "café " * 30_000, "y", 8)], "doc_id long, text string, ids string, decoded int")
    one = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    two = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert one == two
    assert bytes(one[4]["decoded"]).decode() == "café " * 30_000
    assert bpe.round_trip(docs.where("false")).count() == 0


def test_what_a_worker_remembers_is_bounded():
    own = bpe.codec()
    for k in range(4):
        own.ids(" ".join(f"w{i}x{k}" for i in range(bpe.REMEMBERED // 2)))
        assert len(own.cache) <= bpe.REMEMBERED and len(own.earlier) <= bpe.REMEMBERED
    own.ids("q" * 10_000)
    assert max(map(len, own.cache)) <= bpe.SHORT
