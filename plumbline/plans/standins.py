"""Stand-ins for a completion service, for queries and tests: no model, the same answer each time."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

from plumbline.operators.repair import Candidates


@lru_cache(maxsize=64)
def _cut(pattern: str, prompt: str) -> tuple[str, ...]:
    return tuple(re.findall(pattern, prompt))


@dataclass(frozen=True)
class Recited:
    """A deterministic stand-in for a model: it goes on in its prompt's own tokens, with the same candidates everywhere, ``chunk`` tokens at a time."""

    candidates: tuple[tuple[str, float], ...]
    pattern: str = r"[ \n]*[^ \n]+|[ \n]+"
    chunk: int = 20

    def continue_(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> tuple[list[str], list[Candidates]]:
        more = _cut(self.pattern, prompt)[len(tokens) : len(tokens) + min(most, self.chunk)]
        return more, [self.candidates] * len(more)


@dataclass(frozen=True)
class RecitedStream(Recited):
    """The same as a stream of tokens."""

    def stream(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> Iterator[tuple[str, Candidates]]:
        for token in _cut(self.pattern, prompt)[len(tokens) : len(tokens) + most]:
            yield token, self.candidates


@dataclass(frozen=True)
class Cycling:
    """A deterministic stand-in for a model: it goes through a word list."""

    vocabulary: tuple[str, ...]
    length: int = 20

    def continue_(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> tuple[list[str], list[Candidates]]:
        n = min(most, max(0, self.length - len(tokens)))
        v = self.vocabulary
        at = [(doc_id + len(tokens) + k) % len(v) for k in range(n)]
        return [v[i] for i in at], [[(v[(i + j) % len(v)], -0.5 * j) for j in range(len(v))] for i in at]
