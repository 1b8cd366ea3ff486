"""Rule matching: phrases, regular expressions and n-grams.

All matchers are expressions over one row's text: no shuffle, no join, no Python. A rule list is
a literal (an alternation or a hash set), so it has the size of a ban list. A null text has no hits:
single hits are null, lists of hits empty or null, and exploding them gives no rows.

Offsets are code points of the text as it is: it is lower-cased character for character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx

#: Kinds in the order that settles ties.
PHRASE, REGEX, NGRAM = "phrase", "regex", "ngram"
HIT = "struct<kind:string,prio:int,start:int,length:int,rule:string,match:string,detail_key:string>"


@dataclass(frozen=True)
class Rules:
    """Ban lists. ``tie``: which of the phrases that start at one place is meant, the shortest or the longest.

    ``regex_reach``: characters before a change within which a pattern's match that depends on it
    begins, where texts grow piece by piece; ``regex_span``: the same in tokens; none: any number, so all
    of the text is searched again.
    """

    phrases: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    ngrams: tuple[tuple[str, ...], ...] = ()
    remove_stopwords: bool = True
    tie: str = "shortest"
    regex_reach: int | None = None
    regex_span: int | None = None
    stopwords: tuple[str, ...] = field(default=tuple(tx.STOPWORDS), repr=False)


def _edge(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM"


class _Branch:
    """A node of the tree of all phrases: whether one ends here, and what may follow."""

    __slots__ = ("ends", "then")

    def __init__(self):
        self.then: dict[str, _Branch] = {}
        self.ends = False


def _tree(phrases: Sequence[str]) -> _Branch:
    root = _Branch()
    for p in phrases:
        node = root
        for c in p:
            node = node.then.setdefault(c, _Branch())
        node.ends = True
    return root


def _factored(node: _Branch, last: str, shortest: bool) -> str:
    """What may follow in a text after what leads to a node, as a pattern. Text decides the way down, so the order of branches does not matter, but whether a phrase's end comes first."""
    run = ""
    while not node.ends and len(node.then) == 1:  # a way without a choice
        last, node = next(iter(node.then.items()))
        run += last
    out = tx.quoted(run) if run else ""
    end = ("(?!" + tx.WORD_CHAR + ")" if _edge(last) else "") if node.ends else None
    if not node.then:
        return out + (end or "")
    each = [(tx.quoted(c) + _factored(child, c, shortest)) for c, child in sorted(node.then.items())]
    ways = "|".join(each) if len(each) < 4 else f"(?=[{_listed(node.then)}])(?:{'|'.join(each)})"
    if end is None:
        return f"{out}(?:{ways})"
    return f"{out}(?:{end}|{ways})" if shortest else f"{out}(?:{ways}|{end})"


def _listed(chars: Iterable[str]) -> str:
    """Characters as the inside of a class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars))


def phrase_pattern(phrases: Sequence[str], tie: str = "shortest") -> str:
    """One pattern for all phrases, factored by their common beginnings, so that its time hardly grows with the list.

    A side needs a word boundary only if the phrase has a word character there.
    """
    root = _tree(sorted({tx.lowered(p) for p in phrases if p}))
    kinds = []
    for word in (True, False):
        own = _Branch()
        own.then = {c: n for c, n in root.then.items() if _edge(c) is word}
        if own.then:
            kinds.append(("(?<!" + tx.WORD_CHAR + ")" if word else "") + f"(?=[{_listed(own.then)}])" + _factored(own, "", tie == "shortest"))
    return "(?:" + "|".join(kinds) + ")" if kinds else "(?!)"


def _hit(kind: str, prio: int, start: Column, length: Column, rule: Column, match: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(prio).alias("prio"), start.cast("int").alias("start"), length.cast("int").alias("length"), rule.alias("rule"), match.alias("match"), key.alias("detail_key"))


def phrase_first(text: Column, rules: Rules) -> Column:
    """The leftmost phrase hit; null if none."""
    p = phrase_pattern(rules.phrases, rules.tie)
    hit = lambda low: lambda found: F.when(found.isNotNull(), _hit(PHRASE, 0, tx.start_of(low, p), F.length(found), found, found, found)).cast(HIT)
    return tx.let(tx.lower(text), lambda low: tx.let(F.regexp_substr(low, F.lit(p)), hit(low)))


def phrase_all(text: Column, rules: Rules) -> Column:
    """All leftmost non-overlapping phrase hits."""
    found = tx.spans(tx.lower(text), phrase_pattern(rules.phrases, rules.tie))
    return F.transform(found, lambda s: _hit(PHRASE, 0, s["start"], F.length(s["match"]), s["match"], s["match"], s["match"])).cast(f"array<{HIT}>")


def valid(regexes: Sequence[str]) -> list[tuple[int, str]]:
    """(number, pattern) of the patterns that compile; others are left out, and keep their numbers to themselves."""
    out = []
    for k, r in enumerate(regexes):
        try:
            re.compile(r, re.I | re.M | re.S)
        except re.error:
            continue
        if re.search(r"\\[1-9]|\(\?P=|\\k<", r):
            raise ValueError(f"a pattern with back-references can't be fused: {r}")
        out.append((k, r))
    return out


def regex_pattern(regexes: Sequence[str]) -> str:
    """All valid patterns as one, each a named group. Patterns that refer to their own groups can't be fused."""
    return "(?imsU)" + "|".join(f"(?<P{k}>{r.replace('(?P<', '(?<')})" for k, r in found) if (found := valid(regexes)) else "(?!)"


def regex_first(text: Column, rules: Rules) -> Column:
    """The leftmost regex hit; of patterns that match there, the first."""
    fused, found = regex_pattern(rules.regexes), valid(rules.regexes)
    if not found:
        return F.lit(None).cast(HIT)
    names = F.array(*[F.lit(r) for _, r in found])

    def hit(match: Column) -> Column:
        # One pass tells where the first match is and which of the patterns it is: the groups are written out around it.
        groups = "".join(f"${{P{k}}}{tx.MARKS[1]}" for k, _ in found)
        parts = F.split(F.regexp_replace(text, fused, f"{tx.MARKS[0]}{groups}{tx.MARKS[0]}"), tx.MARKS[0], 3)
        which = lambda g: F.array_position(F.transform(F.split(g, tx.MARKS[1], -1), lambda x: x != ""), True)
        quick = tx.let(parts, lambda p: F.struct(F.length(p[0]).alias("start"), which(p[1]).cast("int").alias("rule")))
        return tx.let(F.when(tx.unmarked(text), quick).otherwise(_slowly(text, fused, found)), lambda at: tx.let(F.get(names, at["rule"] - 1), lambda r: _hit(REGEX, 1, at["start"], F.length(match), r, match, F.concat_ws("_", r, match)).cast(HIT)))

    return tx.let(F.regexp_substr(text, F.lit(fused)), lambda match: F.when(match.isNotNull() & (match != ""), hit(match)))


def _slowly(text: Column, fused: str, found: Sequence[tuple[int, str]]) -> Column:
    """The same for texts that hold the marks themselves: a pass for each pattern."""
    which, group, numbers = F.lit(None).cast("int"), 1, []
    for place, (_, r) in enumerate(found):
        numbers.append((place + 1, group))
        group += 1 + re.compile(r).groups
    for place, number in reversed(numbers):
        which = F.when(F.regexp_extract(text, fused, number) != "", F.lit(place)).otherwise(which)
    return F.struct(tx.start_of(text, fused).alias("start"), which.alias("rule"))


def regex_first_timed(docs: DataFrame, rules: Rules, text: str = "text", seconds: float = 2.0) -> DataFrame:
    """``docs`` with ``hit``, as ``regex_first`` gives it, and ``timed_out``: whether the patterns took longer on this text than allowed, which counts as no hit.

    For patterns that may run away: the JVM's matcher cannot be stopped, so texts go through
    Python in Arrow batches. Needs the ``regex`` package. A null text has no hit.
    """
    out = T.StructType([T.StructField("hit", T.StructType.fromDDL(HIT[7:-1].replace(":", " "))), T.StructField("timed_out", T.BooleanType())])

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        found = valid(rules.regexes)
        fused = regex.compile("|".join(f"(?P<P{k}>{r})" for k, r in found) or "(?!)", regex.I | regex.M | regex.S | regex.V0)

        def one(t: str | None) -> tuple[dict | None, bool]:
            try:
                m = fused.search(t, timeout=seconds) if t else None
            except TimeoutError:
                return None, True
            if m is None or not m.group():
                return None, False
            rule = next(r for k, r in found if m.group(f"P{k}") is not None)
            return {"kind": REGEX, "prio": 1, "start": m.start(), "length": len(m.group()), "rule": rule, "match": m.group(), "detail_key": f"{rule}_{m.group()}"}, False

        for batch in batches:
            each = [one(t) for t in batch]
            yield pd.DataFrame({"hit": pd.Series([h for h, _ in each], dtype=object), "timed_out": [t for _, t in each]})

    kept = [c for c in docs.columns if c.lower() not in ("hit", "timed_out")]
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), run.asNondeterministic()(F.col(text)).alias("timed"))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], "timed.hit", "timed.timed_out")


def ngram_hits(text: Column, rules: Rules) -> Column:
    """All n-gram hits: ``start`` is where the first word begins, ``length`` an estimate from the words alone."""
    by_n: dict[int, list[str]] = {}
    for g in rules.ngrams:
        by_n.setdefault(len(g), []).append(" ".join(tx.lowered(w) for w in g))
    empty = F.array().cast("array<struct<at:int,n:int,key:string>>")
    if not by_n:
        return empty
    numbered = F.transform(F.regexp_extract_all(tx.lower(text), F.lit(tx.WORD), F.lit(0)), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    kept = F.filter(numbered, lambda x: ~x["w"].isin(list(rules.stopwords))) if rules.remove_stopwords else numbered
    possible = _possible(tx.lower(text), [g for keys in by_n.values() for g in keys])
    found = tx.let(kept, lambda a: F.concat(empty, *[_among(_grams(a, n), keys) for n, keys in sorted(by_n.items())]))
    return F.when(possible, found).otherwise(empty)


def _possible(low: Column, keys: Sequence[str]) -> Column:
    """Whether a text can have a hit at all: what some n-gram needs is in it. Texts without are not cut into words."""
    if len(keys) <= 32:
        each = []
        for key in keys:
            need = F.lit(True)
            for w in key.split(" "):
                need = need & F.contains(low, F.lit(w))
            each.append(need)
        out = F.lit(False)
        for need in each:
            out = out | need
        return out
    return low.rlike("|".join(tx.quoted(w) for w in sorted({k.split(" ")[0] for k in keys})))


def _grams(kept: Column, n: int) -> Column:
    return F.transform(tx.shifted(kept, n), lambda x: F.struct(x["0"]["at"].alias("at"), F.lit(n).alias("n"), F.concat_ws(" ", *[x[str(k)]["w"] for k in range(n)]).alias("key")))


def _among(grams: Column, keys: Sequence[str]) -> Column:
    return F.filter(grams, lambda g: g["key"].isin(list(keys)))


def word_start(text: Column, at: Column) -> Column:
    """Where the word of this number begins."""
    low = tx.lower(text)
    gaps, ws = F.split(low, tx.WORD, -1), F.regexp_extract_all(low, F.lit(tx.WORD), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return total(F.slice(gaps, F.lit(1), at + 1)) + total(F.slice(ws, F.lit(1), at))


def _first_ngram(text: Column, rules: Rules) -> Column:
    return F.array_min(F.transform(ngram_hits(text, rules), lambda h: F.struct(h["at"].alias("at"), (-h["n"]).alias("n"), h["key"].alias("key"))))


def ngram_first(text: Column, rules: Rules) -> Column:
    """The first n-gram hit; of those that begin at one word, the longest."""
    return tx.let(_first_ngram(text, rules), lambda first: ngram_of(text, first, rules))


def ngram_of(text: Column, first: Column, rules: Rules) -> Column:
    """The hit that ``at, n, key`` stands for."""
    key = F.concat(first["key"], F.lit(f" (stopwords_removed={rules.remove_stopwords})"))
    return F.when(first.isNotNull(), _hit(NGRAM, 2, word_start(text, first["at"]), F.length(first["key"]), first["key"], first["key"], key)).cast(HIT)


def first_hits(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``docs`` with ``hits``: the first hit of each kind, with the token that holds its first character."""
    hits = F.array_compact(F.array(phrase_first(F.col(text), rules), regex_first(F.col(text), rules), ngram_first(F.col(text), rules)))
    return docs.withColumn("hits", hits)


def all_hits(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """One row a hit: every phrase hit, every hit of the fused regex, every n-gram hit."""
    t = F.col(text)
    fused = regex_pattern(rules.regexes)
    regex = F.transform(tx.spans(t, fused), lambda s: _hit(REGEX, 1, s["start"], F.length(s["match"]), F.lit(fused), s["match"], s["match"])).cast(f"array<{HIT}>")
    grams = F.transform(ngram_hits(t, rules), lambda h: ngram_of(t, h, rules)).cast(f"array<{HIT}>")
    return docs.withColumn("hit", F.explode(F.concat(phrase_all(t, rules), regex, grams)))
