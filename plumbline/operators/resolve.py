"""From hits to decisions: tokens, suppression, the earliest violation, event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators.match import HIT


def with_tokens(hits: DataFrame, text: str = "text") -> DataFrame:
    """Hits with ``token``, the number of the token that holds the first character of ``hit``; those beyond the text are dropped."""
    return hits.withColumn("token", tx.token_at(F.col(text), F.col("hit.start"))).where("token is not null")


def earliest_of(skip: tuple[str, ...] = (), text: str = "text") -> Column:
    """Of ``hits`` of one row, the one in the earliest token; ties go to the kind first in order. No shuffle."""
    kept = F.filter("hits", lambda h: ~h["kind"].isin(list(skip))) if skip else F.col("hits")
    placed = F.transform(kept, lambda h: F.struct(tx.token_at(F.col(text), h["start"]).alias("token"), h["prio"].alias("prio"), h.alias("hit")))
    return F.array_min(F.filter(placed, lambda x: x["token"].isNotNull()))


def unsuppressed(hits: DataFrame, suppressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits without those that ``suppressed(key, kind, token, detail_key)`` lists; taken out before the earliest is sought, so later hits show."""
    h, s = hits.alias("h"), suppressed.alias("s")
    same = [F.col(f"h.{key}") == F.col(f"s.{key}"), F.col("h.hit.kind") == F.col("s.kind"), F.col("h.token") == F.col("s.token"), F.col("h.hit.detail_key") == F.col("s.detail_key")]
    return h.join(s, same, "left_anti")


def masked(hits: DataFrame, suppressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The other reading: each kind has one hit, its earliest, and where that is suppressed the kind is silent."""
    first = hits.groupBy(key, F.col("hit.kind").alias("_k")).agg(F.min(F.struct("token", F.col("hit.start").alias("s"), "hit")).alias("f"))
    return unsuppressed(first.select(key, F.col("f.token").alias("token"), F.col("f.hit").alias("hit")), suppressed, key)


def earliest(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The earliest hit of each document by (token, kind's order, start)."""
    order = F.struct("token", F.col("hit.prio").alias("p"), F.col("hit.start").alias("s"), (-F.col("hit.length")).alias("l"), F.col("hit.rule").alias("r"))
    return hits.groupBy(key).agg(F.min_by(F.struct("token", "hit"), order).alias("v")).select(key, "v.token", "v.hit")


def placed(hits: Column, text: Column) -> Column:
    """Hits of one row with their tokens, in the order in which they count; those beyond the text are dropped. Tokens are counted on from hit to hit."""
    inside = F.array_sort(F.transform(F.filter(hits, lambda h: (h["start"] >= 0) & (h["start"] < F.length(text))), lambda h: F.struct(h["start"].alias("start"), h.alias("hit"))))
    out = "array<struct<token:int,prio:int,start:int,minus:int,rule:string,hit:" + HIT + ">>"

    def step(s: Column, x: Column) -> Column:
        h, token = x["hit"], s["token"] + tx.tokens_after(text, s["at"], x["start"])
        one = F.struct(token.cast("int").alias("token"), h["prio"].alias("prio"), h["start"].alias("start"), (-h["length"]).alias("minus"), h["rule"].alias("rule"), h.alias("hit"))
        return F.struct(x["start"].alias("at"), token.cast("int").alias("token"), F.concat(s["out"], F.array(one)).alias("out"))

    begun = lambda at: F.struct(at.alias("at"), F.coalesce(tx.token_at(text, at), F.lit(0)).cast("int").alias("token"), F.array().cast(out).alias("out"))
    parts = tx.parted(inside, lambda at, x: x["start"], lambda part, at: F.aggregate(part, begun(at), step, lambda s: s["out"]))
    return F.array_sort(F.flatten(parts))


def first_unsuppressed(found: Column, suppressed: Column) -> Column:
    """Of ``placed`` hits of one row, the first that ``suppressed``, an array of (kind, token, detail_key), does not list. No shuffle."""
    key = lambda x: F.struct(x["hit"]["kind"].alias("kind"), x["token"].alias("token"), x["hit"]["detail_key"].alias("detail_key"))
    return F.get(F.filter(found, lambda x: ~F.coalesce(F.array_contains(suppressed, key(x)), F.lit(False))), F.lit(0))


def first_masked(found: Column, suppressed: Column, kinds: tuple[str, ...] = ("phrase", "regex", "ngram")) -> Column:
    """The other reading: each kind has one hit, its first, and where that is suppressed the kind is silent."""
    first = lambda kind: F.get(F.filter(found, lambda x: x["hit"]["kind"] == kind), F.lit(0))
    firsts = F.array_compact(F.array(*[first(k) for k in kinds]))
    return first_unsuppressed(F.array_sort(firsts), suppressed)


def suppressed_lists(suppressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, suppressed`` of ``suppressed(key, kind, token, detail_key)``: a list for each document, to be joined once."""
    return suppressed.groupBy(key).agg(F.collect_set(F.struct("kind", "token", "detail_key")).alias("suppressed"))


def message(hit: Column) -> Column:
    """One line for a console or log: what was banned."""
    return (
        F.when(hit["kind"] == "phrase", F.concat(F.lit("banned phrase '"), hit["rule"], F.lit("'")))
        .when(hit["kind"] == "regex", F.concat(F.lit("banned pattern /"), hit["rule"], F.lit("/ at '"), hit["match"], F.lit("'")))
        .when(hit["kind"] == "ngram", F.concat(F.lit("banned n-gram '"), hit["rule"], F.lit("'")))
        .otherwise(F.substring(F.to_json(hit), 1, 80))
    )


def token_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, token, start, end``: tokens in long form. The prefix sum of lengths stays within a document."""
    long = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(tx.TOKEN), F.lit(0))).alias("pos", "token"))
    end = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return long.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))


def tokens_at(offsets: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``offsets(key, offset)`` with ``pos``, the token that holds it; null out of range. Equality on the document, range within it."""
    o, t = offsets.alias("o"), tokens.select(key, "pos", "start", "end").alias("t")
    on = (F.col(f"o.{key}") == F.col(f"t.{key}")) & (F.col("t.start") <= F.col("o.offset")) & (F.col("o.offset") < F.col("t.end"))
    return o.join(t, on, "left").select(f"o.{key}", "o.offset", "t.pos")
