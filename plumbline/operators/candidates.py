"""Replacement candidates: one row a position, its candidates an array of (token, logp).

Everything is array expressions within the row, so no operator here shuffles. An empty or null
list of candidates gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import TOKEN, let

P = "array<struct<token:string,p:double>>"
TOTAL = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["p"])
_pair = lambda token, p: F.struct(token.alias("token"), p.alias("p"))


def softmax(candidates: Column, temperature: float = 1.0, least: float = 1e-3) -> Column:
    """Probabilities at a temperature, over all candidates given; even where they all vanish."""
    raw = F.transform(candidates, lambda c: _pair(c["token"], F.pow(F.exp(c["logp"]), F.lit(1.0 / max(temperature, least)))))
    return let(F.coalesce(raw, F.array().cast(P)), _scaled)


def _scaled(raw: Column) -> Column:
    share = lambda z: F.transform(raw, lambda c: _pair(c["token"], F.when(z > 0, c["p"] / F.when(z > 0, z)).otherwise(F.lit(1.0) / F.size(raw))))
    return let(TOTAL(raw), share).cast(P)


def without(probs: Column, *tokens: Column) -> Column:
    """Candidates but these. What is left is not scaled up again."""
    return untried(probs, F.array(*tokens))


def untried(probs: Column, tried: Column) -> Column:
    """Candidates but those of an array of tokens."""
    return let(F.coalesce(tried, F.array().cast("array<string>")), lambda ts: F.filter(probs, lambda c: ~F.coalesce(F.array_contains(ts, c["token"]), F.lit(False))))


def min_p(probs: Column, share: float) -> Column:
    """Candidates of at least this share of the best one's probability."""
    best = lambda ps: F.array_max(F.transform(ps, lambda c: c["p"]))
    return let(probs, lambda ps: let(best(ps), lambda m: F.filter(ps, lambda c: c["p"] >= share * m)))


def ranked(probs: Column) -> Column:
    """By probability, the greatest first; ties by token."""
    return F.transform(F.array_sort(F.transform(probs, lambda c: F.struct((-c["p"]).alias("minus"), c["token"].alias("token")))), lambda c: _pair(c["token"], -c["minus"]))


def top_p(probs: Column, share: float) -> Column:
    """The most likely candidates up to and with the one that reaches this share of probability, by one running sum."""
    begun = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda s, c: F.struct((s["sum"] + c["p"]).alias("sum"), F.when(s["sum"] < share, s["n"] + 1).otherwise(s["n"]).alias("n"))
    return let(ranked(probs), lambda ps: F.slice(ps, F.lit(1), F.aggregate(ps, begun, step, lambda s: s["n"])))


def top_k(probs: Column, k: int) -> Column:
    """The k most likely candidates."""
    return F.slice(ranked(probs), 1, k)


def inverted(probs: Column) -> Column:
    """The order of probabilities turned round: (greatest - p) + least, scaled to 1; even where that vanishes."""
    ends = lambda ps: F.struct(F.array_max(F.transform(ps, lambda c: c["p"])).alias("high"), F.array_min(F.transform(ps, lambda c: c["p"])).alias("low"))
    turned = let(probs, lambda ps: let(ends(ps), lambda e: F.transform(ps, lambda c: _pair(c["token"], e["high"] - c["p"] + e["low"]))))
    return let(turned, _scaled)


def rungs(temperature: float, p: float | None, share: float | None, k: int | None, relax: bool = True) -> list[tuple]:
    """The settings to try in turn: as given; temperature 1; without min-p; without top-p; without top-k."""
    ladder = [(temperature, share, p, k), (1.0, share, p, k), (1.0, None, p, k), (1.0, None, None, k), (1.0, None, None, None)]
    return ladder if relax else ladder[:1]


def filtered(candidates: Column, banned: Column, setting: tuple) -> Column:
    """One rung: temperature over all, the banned token out, then min-p, top-p, top-k."""
    temperature, share, p, k = setting
    out = without(softmax(candidates, temperature), banned)
    out = min_p(out, share) if share is not None else out
    out = top_p(out, p) if p is not None and p < 1.0 else out
    return top_k(out, k) if k is not None else ranked(out)


def laddered(df: DataFrame, banned: str, tried: str | None, ladder: Sequence[tuple], invert: bool = False, candidates: str = "candidates") -> DataFrame:
    """``rung`` and ``kept`` of the first rung that leaves an untried candidate; both null if none does. Only the first two rungs are inverted."""
    seen = F.coalesce(F.col(tried), F.array().cast("array<string>")) if tried else F.array().cast("array<string>")
    rung, kept = F.lit(None).cast("int"), F.lit(None).cast(P)
    for n in reversed(range(len(ladder))):
        probs = filtered(F.col(candidates), F.col(banned), ladder[n])
        probs = inverted(probs) if invert and n < 2 else probs
        left = untried(F.filter(probs, lambda c: c["p"] > 0), seen)
        df = df.withColumn(f"_r{n}", left)
        rung, kept = F.when(F.size(f"_r{n}") > 0, F.lit(n)).otherwise(rung), F.when(F.size(f"_r{n}") > 0, F.col(f"_r{n}")).otherwise(kept)
    return df.withColumn("rung", rung).withColumn("kept", kept).drop(*[f"_r{n}" for n in range(len(ladder))])


def choose(kept: Column, *key: Column, seed: int = 1) -> Column:
    """A candidate drawn with its probability, the same in every run and in SQL: an exponential race whose draws are digests of seed, key and token."""
    told = lambda c: F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key], c["token"])
    u = lambda c: (F.conv(F.substring(F.md5(told(c).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.array_min(F.transform(kept, lambda c: F.struct((-F.log(u(c)) / c["p"]).alias("t"), c["token"].alias("token"))))["token"]


def tail(candidates: Column, banned: Column, share: float = 0.01, most: int = 50, limit: int = 20, prefixes: Sequence[str] = (), tried: Column | None = None) -> Column:
    """The unlikely end of the plausible candidates, the least likely first: what a pair may name as better.

    Left out: the banned token, tokens tried, those that begin a banned rule, those with an
    asterisk, of one character or less, or without letters and digits.
    """
    probs = F.reverse(top_k(min_p(without(softmax(candidates), banned), share), most))
    bare = lambda c: F.regexp_replace(c["token"], r"(?U)^\s+|\s+$", "")
    ok = lambda c: (~F.contains(c["token"], F.lit("*"))) & (F.length(bare(c)) > 1) & c["token"].rlike(r"[\p{L}\p{N}]")
    kept = F.filter(probs, ok)
    if prefixes:
        kept = F.filter(kept, lambda c: ~F.lower(c["token"]).isin(list(prefixes)) & ~F.lower(bare(c)).isin(list(prefixes)))
    if tried is not None:
        kept = untried(kept, tried)
    return F.slice(kept, 1, limit)


def select_tail(logits: Column, temperature: float = 1.0, share: float | None = None, k: int = 50, most: int = 20) -> Column:
    """The least likely of the plausible, the unlikeliest first: softmax at a temperature, min-p (scaled anew; the best one always stays), top-k, the last of these."""
    scaled = let(F.coalesce(logits, F.array().cast("array<struct<token:string,logit:double>>")), lambda ls: F.transform(ls, lambda c: _pair(c["token"], F.exp((c["logit"] - F.array_max(F.transform(ls, lambda x: x["logit"]))) / temperature))))
    probs = let(scaled, _scaled)
    kept = let(min_p(probs, share), _scaled) if share is not None else probs
    return F.slice(F.reverse(top_k(F.filter(kept, lambda c: c["p"] > 0), k)), 1, most)


def first_token_prefixes(rules: DataFrame, column: str = "rule", token: str = TOKEN) -> DataFrame:
    """``prefix``: the first token of each rule in lower case, as it is and after a blank, each once. ``token``: the pattern of the tokenizer's tokens."""
    base = F.regexp_replace(F.col(column), r"(?U)^\s+", "")
    variants = rules.select(F.explode(F.array(base, F.concat(F.lit(" "), base))).alias("v"))
    return variants.select(F.lower(F.regexp_extract("v", f"^(?:{token})", 0)).alias("prefix")).where("prefix <> ''").distinct()


def prefix_set(rules: Sequence[str], shortest: int = 2, longest: int = 15) -> frozenset[str]:
    """The same as ``rule_prefixes`` for a ban list in hand."""
    known = [r.lstrip().lower() for r in rules]
    return frozenset(lead + r[:n] for r in known for n in range(shortest, min(longest, len(r)) + 1) for lead in ("", " "))


def rule_prefixes(rules: DataFrame, column: str = "rule", shortest: int = 2, longest: int = 15) -> DataFrame:
    """``prefix``: the beginnings of rules of 2 to 15 characters, with and without a blank before, each once."""
    low = F.regexp_replace(F.lower(column), r"(?U)^\s+", "")
    cuts = rules.select(low.alias("r")).where(F.length("r") >= shortest).select("r", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("r")))).alias("n"))
    return cuts.select(F.explode(F.array(F.expr("substring(r, 1, n)"), F.concat(F.lit(" "), F.expr("substring(r, 1, n)")))).alias("prefix")).distinct()
