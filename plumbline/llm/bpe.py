"""Byte-level BPE by monoid tree reduction.

Encoding is a reduction over a binary tree. A long input is halved until its parts are short,
the parts are encoded on their own, and neighbours are joined: the bytes around the seam are
encoded anew in a window that grows until nothing outside can change.

* Within one pre-token: a token sequence is the encoding of its bytes exactly if each two
  adjacent tokens are the encoding of theirs. (Merges are picked by rank, leftmost first. Up to
  the first merge across a boundary, the tokens on its two sides evolve as they would alone, so
  that merge would also happen in the pair alone.) Both parts fulfil this, hence the join is
  final as soon as the two pairs at the window's edges do.
* Within a text: the pattern scans left to right and never looks back, so from a place where
  two scans both begin a pre-token they agree. Only the last pre-tokens of the left part can
  depend on what follows it; scanning goes on from there until it meets a boundary of the right part.

Decoding concatenates byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.session import slices

#: Code points of a text, bytes of a pre-token, and tokens, that are dealt with without halving.
TEXT_LEAF, PIECE_LEAF, DECODE_LEAF = 1 << 16, 48, 1 << 16
#: Encoded pre-tokens that a worker remembers: how many lately met ones and as many earlier ones at most, of how many characters. Some 100 MB.
REMEMBERED, SHORT = 1 << 18, 32
#: Byte strings above this are merged with a heap instead of by looking through all pairs again.
HEAPED = 192

#: Over these characters the general pattern is the same as one over plain ranges, which runs faster.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN_TEXT = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+")


class Decoder:
    """The bytes of each token of a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            of = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [of.get(rank, b"") for rank in range(max(of) + 1)]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids, concatenated up a tree."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class Codec(Decoder):
    """An encoder and decoder for a file of ranks and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        self.ranks = {token: rank for rank, token in enumerate(self.bytes_of) if token}
        self.general = regex.compile(pattern)
        self.plain = _PLAIN if pattern == public_tokenizers.PATTERN else None
        self.cache: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.fits = lru_cache(1 << 14)(self._fits)

    # Pre-tokens

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a byte string: again and again the adjacent pair of least rank, the leftmost of them, becomes one."""
        if len(data) > HEAPED:
            return self._merged_by_heap(data)
        ranks, none, starts = self.ranks, 1 << 60, list(range(len(data) + 1))
        get = ranks.get
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            del starts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(data[starts[i - 1] : starts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(data[starts[i] : starts[i + 2]], none)
        return [ranks[data[a:b]] for a, b in zip(starts, starts[1:])]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        get, n = self.ranks.get, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            # Still the pair that it was: both parts begin and end as then.
            if not alive[i] or ends[i] >= end or ends[ends[i]] != end:
                continue
            alive[ends[i]] = 0
            ends[i] = end
            if end < n:
                before[end] = i
                if (rank := get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[end]))
            if i and (rank := get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (rank, before[i], end))
        return [self.ranks[data[i : ends[i]]] for i in range(n) if alive[i]]

    def _fits(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other.

        The window's bytes are merged outright, never halved again, and it grows to both sides at
        most as far as there is anything, so this ends.
        """
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            left_ok = i == len(left) or self.fits(left[-i - 1], window[0])
            right_ok = j == len(right) or self.fits(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if left_ok else min(len(left), 2 * i)), (j if right_ok else min(len(right), 2 * j))

    def tree(self, data: bytes) -> list[int]:
        """The encoding of a byte string, by halves."""
        if len(data) <= PIECE_LEAF:
            return self.merged(data)
        parts = [self.merged(data[i : i + PIECE_LEAF]) for i in range(0, len(data), PIECE_LEAF)]
        while len(parts) > 1:
            parts = [self.joined(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def piece(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit integers."""
        out = self.cache.get(piece) or self.earlier.get(piece)
        if out is None:
            data = piece.encode()
            rank = self.ranks.get(data)
            ids = [rank] if rank is not None else self.tree(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            # Pre-tokens that are met again move on; what was not met for long is forgotten.
            if len(self.cache) >= REMEMBERED:
                self.cache, self.earlier = {}, self.cache
            self.cache[piece] = out
        return out

    # Texts

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        find = self.plain if self.plain is not None and _PLAIN_TEXT.fullmatch(text) else self.general
        if len(text) <= TEXT_LEAF:
            return b"".join(self.each(find.findall(text)))
        parts = [self.leaf(text, i, find) for i in range(0, len(text), TEXT_LEAF)]
        while len(parts) > 1:
            parts = [self.seamed(text, parts[k], parts[k + 1], find) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids.tobytes()

    def each(self, pieces: Iterable[str]) -> list[bytes]:
        """The ids of each pre-token."""
        get, piece = self.cache.get, self.piece
        return [get(p) or piece(p) for p in pieces]

    def leaf(self, text: str, begin: int, find) -> Part:
        pieces = find.findall(text, begin, min(len(text), begin + TEXT_LEAF))
        return self.part(begin, pieces)

    def part(self, begin: int, pieces: list[str]) -> Part:
        """The encoding of pre-tokens that follow one another from a place in a text."""
        ids = self.each(pieces)
        starts = begin + np.cumsum([0, *map(len, pieces)], dtype=np.int64)
        return Part(starts, np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4, np.frombuffer(b"".join(ids), "<u4"))

    def seamed(self, text: str, left: Part, right: Part, find) -> Part:
        """The encoding of two neighbouring parts of a text as one, scanned anew around the seam.

        Up to three characters before the seam may begin a contraction, and one run of white
        space may end there; what comes before is final. To the right the window grows until the
        scan begins a pre-token where the right part does, and far enough from the window's end.
        """
        seam, end = int(left.starts[-1]), int(right.starts[-1])
        keep = len(left.starts) - 1
        while keep and (seam - left.starts[keep] < 4 or len(left.starts) - 1 - keep < 2):
            keep -= 1
        begin, take = int(left.starts[keep]), 16
        while True:
            until = int(right.starts[min(take, len(right.starts) - 1)])
            between: list[str] = []
            for m in find.finditer(text[begin:until]):
                at = begin + m.start()
                if at >= seam and (until == end or at <= until - 4):
                    j = int(np.searchsorted(right.starts, at))
                    if right.starts[j] == at:
                        return left.upto(keep).followed(self.part(begin, between)).followed(right.since(j))
                between.append(m.group())
            if until == end:
                return left.upto(keep).followed(self.part(begin, between))
            take *= 2

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        data = self.ids(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))


class Part:
    """An encoded stretch of a text: where its pre-tokens start (and the last ends) in the text, and in the ids."""

    __slots__ = ("at", "ids", "starts")

    def __init__(self, starts: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.starts, self.at, self.ids = starts, at, ids

    def upto(self, k: int) -> Part:
        return Part(self.starts[: k + 1], self.at[: k + 1], self.ids[: self.at[k]])

    def since(self, k: int) -> Part:
        return Part(self.starts[k:], self.at[k:] - self.at[k], self.ids[self.at[k] :])

    def followed(self, other: Part) -> Part:
        return Part(np.concatenate([self.starts, other.starts[1:]]), np.concatenate([self.at, self.at[-1] + other.at[1:]]), np.concatenate([self.ids, other.ids]))


_codecs: dict[tuple[str, str | None], Decoder] = {}


def _file(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def codec(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """This process's codec for a rank file; by default the public byte-level vocabulary."""
    key = _file(path), pattern
    return _codecs.get(key) or _codecs.setdefault(key, Codec(*key))


def decoder(path: str | None = None) -> Decoder:
    """This process's decoder: any codec for the file that it has, or one without ranks and patterns."""
    found = next((c for (p, _), c in _codecs.items() if p == _file(path)), None)
    return found or _codecs.setdefault((_file(path), None), Decoder(_file(path)))


def _coded(rows: DataFrame, made: dict[str, Callable[[], Callable]], source: str) -> DataFrame:
    """``rows`` with binary columns, each made of the one before it; the first of column ``source``. Few rows at a time."""
    names = [c for c in rows.columns if c not in made]
    kept = rows.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.BinaryType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [make() for make in made.values()]
        for batch in slices(batches, 64):
            values, columns = batch.column(batch.schema.get_field_index(source)).to_pylist(), []
            for step in steps:
                values = [step(v) for v in values]
                columns.append(pa.array(values, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *made])

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``ids binary``: each text's ids, little-endian unsigned 32-bit; a null text is empty.

    An own column ``ids`` is replaced. Rows are independent, so repeated rows and ties need
    nothing, and an empty table gives an empty one. No shuffle. A very long text is held with
    its ids and the places of its pre-tokens, some 30 bytes a character at most.
    """
    return _coded(docs, {"ids": lambda: _encoding(path, pattern)}, "text")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of ``ids``; null ids give no bytes. An own column ``decoded`` is replaced."""
    return _coded(encoded, {"decoded": lambda: _decoding(path)}, "ids")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, as ``encode`` and then ``decode`` give them, in one pass and one Python worker a core."""
    return _coded(docs, {"ids": lambda: _encoding(path, pattern), "decoded": lambda: _decoding(path)}, "text")


def _encoding(path: str | None, pattern: str) -> Callable[[str | None], bytes]:
    own = codec(path, pattern)
    return lambda text: own.ids(text or "")


def _decoding(path: str | None) -> Callable[[bytes | None], bytes]:
    own = decoder(path)
    return lambda ids: own.decode(memoryview(ids or b"").cast("I"))
