import duckdb
import pytest

import __spark_entry__
from fitlake.operators import series
from fitlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in columns]
    a = sorted(str([plain(row[c]) for c in columns]) for row in ours.collect())
    b = sorted(str([plain(row[i]) for i in at]) for row in theirs.fetchall())
    assert a == b


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ascent_ignores_small_steps(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([0, 2, 1, 4, 5, 9, 7, 3, 3])]
    out = series.ascent(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], ["t"], "v").collect()[0]
    assert (out.ascent, out.descent) == (9.0, 6.0)


def test_empty_series(spark):
    empty = spark.createDataFrame([], "k string, t long, v double")
    assert series.mean_max(empty, ["k"], ["t"], "v", [3]).count() == 0
    assert series.zone_time(empty, ["k"], ["t"], "v", [1.0]).count() == 0
