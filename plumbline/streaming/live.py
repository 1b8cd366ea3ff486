"""Streams: token rates over event time, and chunks assembled and checked as they come.

Watermarks are this engine's own addition: they bound state and decide what comes too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.match import Rules
from plumbline.operators.repair import Matcher

YIELDED = "doc_id long, seq long, text string, hit_kind string, hit_rule string, hit_start int, done boolean"
#: Milliseconds in a unit of ``forget``.
UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(duration: str) -> int:
    """Of a number and a unit, as in "10 minutes"."""
    number, unit = duration.split()
    return int(float(number) * UNITS[unit.lower().rstrip("s")])


def rates(events: DataFrame, key: str, window: str = "5 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """``key, start, end, tokens, rate`` over sliding windows of ``events(ts, key, tokens)``."""
    seconds = F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("w.start"))
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.sum("tokens").alias("tokens"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tokens", (F.col("tokens") / (seconds / 1e6)).alias("rate"))


@lru_cache(16)
def _matcher(rules: Rules) -> Matcher:
    """One for each worker, not for each document."""
    return Matcher(rules)


def checked(chunks: DataFrame, rules: Rules, hold_back: int = 256, every: int = 1, forget: str | None = None) -> DataFrame:
    """Chunks ``doc_id, seq, text, done`` in, safe text and the first violation out.

    State is a document's text that was not handed out, the character before it (so that a word
    cut in two is not taken for a whole one), and how much was handed out. The last ``hold_back``
    characters stay until more text comes or the document is done, so a violation across chunks
    is seen before its text leaves. Rules run every so many chunks, and at the end; between
    runs no text leaves, unless a violation was found before. Null texts add nothing.

    A document that never says it is done keeps its state, unless ``forget`` (a duration such as
    "1 hour") says how long to wait for its next chunk: then the rest is checked, handed out in a
    row without a ``seq`` that says done, and forgotten.
    """

    def first(matcher: Matcher, before: str, held: str) -> tuple[int, str, str] | None:
        hits = (h for h in matcher.hits(before + held) if h[0] >= len(before))
        found = min(hits, default=None)
        return None if found is None else (found[0] - len(before), matcher.kinds[found[1]], found[4])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, held, out_of, seen, hit = state.get if state.exists else ("", "", 0, 0, False)
        matcher, rows = _matcher(rules), []
        if state.hasTimedOut:
            given = [(None, "", True)]
        else:
            given = [(r.seq, r.text or "", bool(r.done)) for r in pd.concat(list(frames)).sort_values("seq").itertuples()]
        for seq, text, done in given:
            held, seen = held + text, seen + 1
            kind = rule = start = None
            ran = hit or done or seen % every == 0
            if not hit and ran and (found := first(matcher, before, held)) is not None:
                hit, start, kind, rule = True, out_of + found[0], found[1], found[2]
            safe = len(held) if done else max(0, len(held) - hold_back) if ran else 0
            rows.append((key[0], seq, held[:safe], kind, rule, start, done))
            before, held, out_of = (held[safe - 1] if safe else before), held[safe:], out_of + safe
        if rows[-1][-1]:
            state.remove()
        else:
            state.update((before, held, out_of, seen, hit))
            if forget:
                state.setTimeoutDuration(milliseconds(forget))
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "hit_kind", "hit_rule", "hit_start", "done"]).astype({"seq": "Int64", "hit_start": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return chunks.groupBy("doc_id").applyInPandasWithState(step, YIELDED, "before string, held string, out_of long, seen long, hit boolean", "append", timeout)


EDITS = "doc_id long, seq long, op string, at int, token string"
CHANGES = "doc_id long, seq long, length int, changed array<struct<at:int,token:string>>, over boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Keep the state of queries that start from now on in RocksDB, which ``edited`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Tokens(StatefulProcessor):
    """A document's tokens as a map from places, and how many there are."""

    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "at int", "token string", self.forget)
        self.length = handle.getValueState("length", "n int", self.forget)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = before = self.length.get()[0] if self.length.exists() else 0
        changed: dict[int, str] = {}
        last = None
        for row in sorted(rows, key=lambda r: (r["seq"] is not None, r["seq"])):
            last, op, at, token = row["seq"], row["op"], row["at"], row["token"] or ""
            if op not in ("append", "truncate", "commit", "replace"):
                raise ValueError(f"no such edit: {op}")
            if op == "append":
                changed[n], n = token, n + 1
            elif at is not None and 0 <= at < n:
                if op != "replace":
                    changed = {k: v for k, v in changed.items() if k < at} if at < n - 1 else changed
                    n = at + (op == "commit")
                if op == "truncate":
                    changed.pop(at, None)
                else:
                    changed[at] = token
        changed = {k: v for k, v in changed.items() if k < n}
        for k, v in changed.items():
            self.tokens.updateValue((k,), (v,))
        for k in range(n, before):  # what was cut away is not kept
            self.tokens.removeKey((k,))
        self.length.update((n,))
        if self.forget is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        yield Row(doc_id=key[0], seq=last, length=n, changed=[Row(at=k, token=v) for k, v in sorted(changed.items())], over=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        n = self.length.get()[0] if self.length.exists() else 0
        self.tokens.clear()
        self.length.clear()
        yield Row(doc_id=key[0], seq=None, length=n, changed=[], over=True)

    def close(self) -> None:
        """Nothing to give back."""


def edited(edits: DataFrame, forget: str | None = None) -> DataFrame:
    """Token lists that are appended to, cut back and changed as edits come; after each batch, what has changed.

    ``op``: ``append`` adds ``token``; ``truncate`` drops what is at ``at`` and after; ``replace``
    puts ``token`` at ``at`` and keeps what follows; ``commit`` cuts back to ``at`` and puts ``token``
    there, as a replacement in a text that is still written does. Places beyond the end change nothing.

    A batch costs what its edits touch, however long a list is: state holds a token a key. Rows say how
    long a list is now, and which places hold which tokens; ``lists`` puts them together. With
    ``forget`` (a duration such as "1 hour") a list without edits for so long is dropped, and a row
    says that it is ``over``. The query must run with RocksDB (``use_rocks``), in mode ``update``.
    """
    mode = "none" if forget is None else "processingTime"
    return edits.groupBy("doc_id").transformWithState(_Tokens(None if forget is None else milliseconds(forget)), CHANGES, "Update", mode)


def lists(changes: DataFrame) -> DataFrame:
    """``doc_id, tokens, text`` of a table of what ``edited`` gave: of each place within the last length, the last token. A list is one task's."""
    length = F.max(F.struct("seq", "length")).over(Window.partitionBy("doc_id"))["length"]
    places = changes.where("not over").withColumn("length", length).select("doc_id", "seq", "length", F.explode_outer("changed").alias("c"))
    each = places.groupBy("doc_id", "length", "c.at").agg(F.max_by("c.token", "seq").alias("token"))
    placed = each.groupBy("doc_id", "length").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("a"))
    tokens = F.transform(F.filter("a", lambda x: x["at"] < F.col("length")), lambda x: x["token"])
    return placed.select("doc_id", tokens.alias("tokens"), F.array_join(tokens, "").alias("text"))


def applied(tokens: list[str], op: str, at: int | None, token: str | None) -> list[str]:
    """A token list after one edit."""
    if op == "append":
        return [*tokens, token or ""]
    if at is None or not 0 <= at < len(tokens):
        return tokens
    if op == "truncate":
        return tokens[:at]
    if op == "commit":
        return [*tokens[:at], token or ""]
    if op == "replace":
        return [*tokens[:at], token or "", *tokens[at + 1 :]]
    raise ValueError(f"no such edit: {op}")
