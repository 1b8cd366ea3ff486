"""Every query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from plumbline.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_all_have_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.sql(ORACLES[name])
    names = found.columns
    theirs = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", ["regex_lookahead_hit", "fixpoint_backtrack", "run_log", "run_pairs", "token_pairs", "unsuppressed_violation"])
def test_not_vacuous(spark, name):
    rows = QUERIES[name](spark, SF)
    assert not rows.isEmpty()
    if name == "run_log":
        assert {r["status"] for r in rows.select("status").distinct().collect()} == {"success", "failed", "skipped"} and rows.agg({"events": "sum"}).first()[0] > 0
    if name == "fixpoint_backtrack":
        assert rows.where("events > 0").count() > 10 and rows.where("not settled").isEmpty()
