"""Ban lists. They are small files: read on the driver, used as literals or broadcast tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.config import Bans
from plumbline.functions.text import STOPWORDS
from plumbline.operators.match import Rules


def _json(spark: SparkSession, path: str) -> Any:
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def phrases(items: Sequence[Any], top: int | None = None) -> dict[str, float]:
    """Lower-case phrase -> score, of the first ``top`` in file order; a later repetition counts, malformed items don't."""
    kept = list(items) if top is None else list(items)[: max(0, top)]
    out: dict[str, float] = {}
    for item in kept:
        phrase, score = (item[0], item[1] if len(item) > 1 else 0.0) if isinstance(item, (list, tuple)) and item else (None, 0.0)
        if isinstance(phrase, str) and phrase and isinstance(score, (int, float)) and not isinstance(score, bool):
            out[phrase.lower()] = float(score)
    return out


def regexes(items: Any) -> list[str]:
    """The strings of a list; of anything else none."""
    return [x for x in items if isinstance(x, str)] if isinstance(items, list) else []


def ngrams(items: Sequence[Any], remove_stopwords: bool = True, stopwords: Sequence[str] = tuple(STOPWORDS)) -> list[tuple[str, ...]]:
    """Word tuples, each once, in order: strings are cut into words, of lists the items that are words are kept."""
    out: dict[tuple[str, ...], None] = {}
    for item in items:
        if isinstance(item, str):
            ws = re.findall(r"[^\W\d_]+", item.lower())
        elif isinstance(item, (list, tuple)):
            ws = [w.lower() for w in item if isinstance(w, str) and w.isalpha()]
        else:
            continue
        key = tuple(w for w in ws if not (remove_stopwords and w in stopwords))
        if key:
            out[key] = None
    return list(out)


def lengths(rules: Sequence[Sequence[str]]) -> tuple[int, int]:
    """The least and greatest number of words in a rule; 0, 0 for none."""
    sizes = [len(r) for r in rules]
    return (min(sizes), max(sizes)) if sizes else (0, 0)


def load(spark: SparkSession, bans: Bans, regex_reach: int | None = None, regex_span: int | None = None) -> Rules:
    """The rules that a configuration names. N-grams: a list from the command line, else a file, else an inline list."""
    found = phrases(_json(spark, bans.slop_phrases_file), bans.top_n_slop_phrases) if bans.slop_phrases_file else {}
    patterns = regexes(_json(spark, bans.regex_blocklist_file)) if bans.regex_blocklist_file else []
    items = bans.ngram_cli_list or (_json(spark, bans.ngram_file) if bans.ngram_file else bans.ngram_list)
    return Rules(tuple(found), tuple(patterns), tuple(ngrams(items, bans.remove_stopwords)), bans.remove_stopwords, regex_reach=regex_reach, regex_span=regex_span)


def as_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``kind, rule``: all rules as a table."""
    rows = [("phrase", p) for p in rules.phrases] + [("regex", r) for r in rules.regexes] + [("ngram", " ".join(g)) for g in rules.ngrams]
    return spark.createDataFrame(rows, "kind string, rule string")
