"""Every query that has a SQL twin equals it; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in values)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names).collect()) == rows(cur.fetchall())


def test_entry_has_the_surveyed_value(spark):
    got = entry.entry(spark).collect()
    assert [(r["lkfs"], r["gated_blocks"]) for r in got] == [(-11.508405, 15)]


def test_plans_have_no_cartesian_product(spark):
    for name in ("gated_loudness", "silence_spans", "crossfade_stitch", "true_peak", "route_fallback"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
