"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: whatever the regex matches
contains those trigrams, in lower case. One pass over each text's trigrams gives the index: posting
lists (trigram, block of documents) of those that some rule's query names; a posting of any other
trigram could never be consulted. Within each block, posting lists are intersected and united as the queries
say, and the rules are run over the candidates only. A rule without mandatory trigrams scans
every text. Blocks are dealt by a hash of the row, so no posting list grows with a frequent
trigram, only with the block.

Everything that touches rows is DataFrame operations. The rules' queries are derived once, in
plain Python, when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let, parted

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: Documents in a block of the index, about.
BLOCK = 4096
#: Strings that an exact set may hold before it is turned into trigrams.
MOST_EXACT = 8


@dataclass(frozen=True)
class Rule:
    """``value``: the group that must have ``least`` characters (0: the whole match). Letters in ``regex`` mean what they say."""

    kind: str
    regex: str
    value: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


#: The base kinds. A run of hex digits or of the access key's class is maximal, so a short one may be left to the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What this engine adds: the forms that issuers publish.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: What is taken out of texts: a private key from its BEGIN line through its END line, or, where that is missing, through the base64 that follows.
_GAP = r"(?:\s|\\[nr])"
_LINE = r"[A-Za-z0-9+/]"
WHOLE_KEY = Rule(
    "pem",
    r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,32}PRIVATE KEY-----"
    rf"|(?:{_GAP}++(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,.-]++)*+(?:{_GAP}++{_LINE}{{40,}}+={{0,2}})++(?:{_GAP}++(?:{_LINE}*[0-9+/]{_LINE}*={{0,2}}|{_LINE}+=={{0,1}}|{_LINE}+(?=[ \t]*(?:[\r\n]|\Z))))?|)",
)
TAKEN_OUT = tuple(WHOLE_KEY if r.kind == "pem" else r for r in BASE + EXTRA)

# A query: True (no constraint), a trigram, ("and", frozenset) or ("or", frozenset).


def both(*parts):
    flat = set()
    for p in parts:
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(*parts):
    if any(p is True for p in parts):
        return True
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    flat = {p for p in flat if not (isinstance(p, tuple) and p[0] == "and" and p[1] & flat)}  # x or (x and y) is x
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def of_strings(strings) -> object:
    """What holds wherever one of the strings occurs."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def trigram_query(regex: str):
    """The query of a regex: each match contains what it names, once in lower case."""
    exact, query = _walk(parser.parse(regex))
    return both(query, True if exact is None else of_strings(exact))


def _walk(nodes):
    """(exact, query): the finite set of lower-case strings that the sequence matches, or None; and what holds besides."""
    exact, query, whole = {""}, True, True
    for op, arg in nodes:
        one, extra = _node(op, arg)
        query = both(query, extra)
        if one is None:
            query, exact, whole = both(query, of_strings(exact)), {""}, False
        elif len(exact) * len(one) > MOST_EXACT and len(exact) > 1:
            query, exact, whole = both(query, of_strings(exact)), (one if len(one) <= MOST_EXACT else {""}), False
        elif len(one) > MOST_EXACT:
            query, exact, whole = both(query, of_strings(exact), of_strings(one)), {""}, False
        else:
            exact = {a + b for a, b in product(exact, one)}
    return (exact, query) if whole else (None, both(query, of_strings(exact)))


def _node(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] <= 64:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= MOST_EXACT else (None, True)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in found):
            # A prefix that all branches share is parsed apart from them; what is left may be empty.
            return set().union(*(e for e, _ in found)), either(*(q for _, q in found))
        return None, either(*(both(q, True if e is None else of_strings(e)) for e, q in found))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if low == 0:
            return ({""} | exact, True) if high == 1 and exact is not None and query is True else (None, True)
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * low}, query
        return None, both(query, True if exact is None else of_strings(exact))
    if op is sre.AT:
        return {""}, True
    return None, True


def named(query) -> set[str]:
    """The trigrams of a query."""
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)


def at_each_place(trigrams: Sequence[str]) -> str:
    """A pattern that matches wherever one of the trigrams begins, and captures it without going past it."""
    by_first: dict[str, list[str]] = {}
    for g in sorted(trigrams):
        by_first.setdefault(g[0], []).append(g[1:])
    return "(?=(" + "|".join(_literal(c) + "(?:" + "|".join(map(_literal, rest)) + ")" for c, rest in by_first.items()) + "))"


def postings(rows: DataFrame, trigrams: Sequence[str], blocks: int) -> DataFrame:
    """``block, trigram, rows``: the inverted index of ``row_key, text`` for these trigrams."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(at_each_place(trigrams)), F.lit(1)))
    block = F.pmod("row_key", F.lit(blocks)).cast("int").alias("block")
    return rows.select(block, "row_key", F.explode(found).alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("row_key").alias("rows"))


def _answer(query, index: Column) -> Column:
    """The rows that a query leaves, from the posting lists of one block."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(index, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [_answer(q, index) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """``row_key, kinds``: for each row that passes some rule's query, those rules. None if no rule has a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    if not queries:
        return None
    blocks = max(1, -(-rows.count() // BLOCK))
    index = postings(rows, sorted(set().union(*map(named, queries.values()))), blocks)
    per_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("index"))
    tagged = lambda kind: lambda key: F.struct(key.alias("row_key"), F.lit(kind).alias("kind"))
    answers = F.array(*[F.transform(_answer(q, F.col("index")), tagged(kind)) for kind, q in sorted(queries.items())])
    return per_block.select(F.explode(F.flatten(answers)).alias("hit")).groupBy("hit.row_key").agg(F.collect_set("hit.kind").alias("kinds"))


_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """``array<struct<start, order, kind, end>>`` of a rule's leftmost matches, in code points.

    A split at the matches gives the gaps between them, and the lengths of gaps and matches add
    up to the positions.
    """
    pattern = F.lit(rule.java)
    match = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.value)), lambda m: F.length(m)) if rule.value else match
    gap = F.transform(F.split(text, rule.java, -1), lambda g: F.length(g))
    steps = F.arrays_zip(gap.alias("gap"), match.alias("match"), value.alias("value"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["match"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = x["match"].isNotNull() & (x["value"] >= rule.least)
        return F.struct(end.alias("at"), F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    moved = lambda at, x: at + x["gap"] + F.coalesce(x["match"], F.lit(0))
    found = parted(steps, moved, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), _none().alias("spans")), step, lambda s: s["spans"]))
    return F.when(F.coalesce(text.rlike(rule.java), F.lit(False)), F.flatten(found)).otherwise(_none())


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + EXTRA, into: str = "spans") -> DataFrame:
    """``docs`` with ``spans array<struct<start, order, kind, end>>`` (or another name), by start, then by the rules' order.

    A null text is empty. Rows that repeat, or share a doc_id, are each scanned; an own column
    of the name is replaced. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64("doc_id", "text")
    found = candidates(docs.select(key.alias("row_key"), text.alias("text")), rules)
    full = {r.kind for r in rules if trigram_query(r.regex) is True}
    packed = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    joined = packed.join(found.select(F.col("row_key").alias("_key"), F.col("kinds").alias("_kinds")), "_key", "left") if found is not None else packed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(rule, order, text)
        parts.append(spans if rule.kind in full else F.when(F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)), spans).otherwise(_none()))
    return joined.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c.lower() != into.lower()], F.array_sort(F.concat(*parts)).alias(into))


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = TAKEN_OUT, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one mark.

    Null texts stay null. Own columns may have any names. Texts are read whole, and the work is in
    proportion to a text's length and to its secrets.
    """
    into = "_spans"
    while into.lower() in [c.lower() for c in docs.columns]:
        into = f"_{into}"
    pair = "array<struct<from:int,to:int>>"

    def step(s, x):
        gap = F.struct(s["at"].alias("from"), x["start"].alias("to"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap))).otherwise(s["out"]).alias("out"))

    # What lies between marks: from the furthest end so far to the start of a span beyond it.
    furthest = lambda at, x: F.greatest(at, x["end"])
    gaps = F.flatten(parted(F.col(into), furthest, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), _none(pair).alias("out")), step, lambda s: s["out"])))

    def cut_parts(part: Column, _: Column) -> Column:
        # A stretch of the text is taken once for all gaps in it, since finding a place takes time in proportion to its distance.
        first = lambda: F.try_element_at(part, F.lit(1))["from"]
        stretch = F.substring(F.col("text"), first() + 1, F.try_element_at(part, F.lit(-1))["to"] - first())
        return let(stretch, lambda t: F.array_join(F.transform(part, lambda g: F.concat(F.substring(t, g["from"] - first() + 1, g["to"] - g["from"]), F.lit(mark))), ""))

    end = F.aggregate(into, F.lit(0), furthest)
    kept = F.concat(F.array_join(parted(gaps, lambda at, _: at, cut_parts), ""), F.substring(F.col("text"), end + 1, F.length("text")))
    found = scan(docs, rules, into)
    return found.withColumn("text", F.when(F.size(into) > 0, kept).otherwise(F.col("text"))).select(*docs.columns)
