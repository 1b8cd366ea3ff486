"""Scoring answers for refusal: what a classifier reads, cut by its own tokens, and what it says.

A scorer is made once for each Python worker and sees texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A scorer: (label, confidence) of each prompt and answer.
Scorer = Callable[[Sequence[str], Sequence[str]], list[tuple[str, float]]]
#: Tokens of the whole input, and of the user's side at most and at least.
MOST, USER_MOST, USER_LEAST = 256, 100, 40


class Tokenizer(Protocol):
    """Cuts a text and puts it together again. Special tokens are not its own."""

    def encode(self, text: str) -> list[Hashable]: ...

    def decode(self, tokens: Sequence[Hashable]) -> str: ...


class Words:
    """Words between blanks, where there is no tokenizer."""

    def encode(self, text: str) -> list[Hashable]:
        return list(text.split(" ")) if text else []

    def decode(self, tokens: Sequence[Hashable]) -> str:
        return " ".join(map(str, tokens))


def wrapped(user: str, assistant: str) -> str:
    """Both sides as a classifier of dialogues reads them."""
    return f"<|user|>\n{user}\n<|assistant|>\n{assistant}"


def truncated(tokenizer: Tokenizer, user: str, assistant: str, most: int = MOST, user_most: int = USER_MOST, user_least: int = USER_LEAST) -> tuple[str, str]:
    """Both sides, so that all fits into ``most`` tokens: the user's is cut to ``user_most``, then down to ``user_least``, then the answer's end goes."""
    asked, said = tokenizer.encode(user), tokenizer.encode(assistant)
    room = most - len(tokenizer.encode(wrapped("", "")))
    kept = asked[:user_most]
    kept = kept[: len(kept) - min(max(0, len(kept) + len(said) - room), max(0, len(kept) - user_least))]
    left = said[: max(0, room - len(kept))]
    return (user if len(kept) == len(asked) else tokenizer.decode(kept)), (assistant if len(left) == len(said) else tokenizer.decode(left))


@dataclass
class LogitScorer:
    """A scorer from a tokenizer and a model that gives a row of logits for each list of tokens."""

    tokenizer: Tokenizer
    logits: Callable[[list[list[Hashable]]], np.ndarray]
    labels: Sequence[str]
    most: int = MOST

    def __call__(self, prompts: Sequence[str], answers: Sequence[str]) -> list[tuple[str, float]]:
        if not prompts:
            return []
        texts = [wrapped(*truncated(self.tokenizer, p, a, self.most)) for p, a in zip(prompts, answers, strict=True)]
        raw = np.asarray(self.logits([self.tokenizer.encode(t)[: self.most] for t in texts]), np.float64)
        odds = np.exp(raw - raw.max(axis=1, keepdims=True))
        share = odds / odds.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [(self.labels[k], float(share[i, k])) for i, k in enumerate(best)]


def judged(rows: DataFrame, scorer: Callable[[], Scorer], prompt: str = "prompt", answer: str = "text", tokenizer: Callable[[], Tokenizer] | None = Words) -> DataFrame:
    """``rows`` with ``label``, ``confidence`` and ``scorer_error``, in one pass: what made the rows is not run again.

    The scorer gets both sides as ``truncated`` leaves them (by ``tokenizer``; none: whole, for
    scorers that cut by themselves). One that can't be made, or fails on a batch, says ``error``
    with confidence 0, and why. Null texts are empty.
    """

    @F.pandas_udf("label string, confidence double, scorer_error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        why, score = "", None
        cut = tokenizer() if tokenizer is not None else None
        try:
            score = scorer()
        except Exception as failed:  # whatever a model's loader raises: the run goes on and says so
            why = f"{type(failed).__name__}: {failed}"
        for prompts, answers in batches:
            sides = list(zip(prompts.fillna(""), answers.fillna(""), strict=True))
            error = why
            if score is not None:
                sides = [truncated(cut, *x) for x in sides] if cut is not None else sides
                try:
                    found = score([u for u, _ in sides], [a for _, a in sides])
                except Exception as failed:
                    error = f"{type(failed).__name__}: {failed}"
            if error:
                found = [("error", 0.0)] * len(sides)
            yield pd.DataFrame({"label": [x for x, _ in found], "confidence": [float(y) for _, y in found], "scorer_error": [error or None] * len(sides)})

    score = run.asNondeterministic()(F.col(prompt).cast("string"), F.col(answer).cast("string"))
    own = {c: F.col(c) for c in rows.columns}
    return rows.select(F.struct(*own.values()).alias("row"), score.alias("said")).select(*[F.col("row")[c].alias(c) for c in own], "said.*")
