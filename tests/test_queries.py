"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

import os

import duckdb
import pytest

from skyloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    one = lambda v: f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(cols).collect())
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == plain([tuple(r[i] for i in order) for r in want.fetchall()])
    assert got, "nothing compared"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["line_truth", "measure_lines", "cross_profile_peak"])
def test_lines_are_traced_once(spark, name):
    """What a place is used for doesn't repeat its trace, which takes one logarithm."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LOG10(") == 1
