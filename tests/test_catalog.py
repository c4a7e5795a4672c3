"""Each named query against its SQL in DuckDB, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from arbora.plans import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return connection


def rows(columns, found):
    return sorted(tuple(str(r[c]) for c in columns) for r in found)


@pytest.mark.parametrize("name", [*catalog.QUERIES, *(n for n in __spark_entry__.oracle_sql() if n not in catalog.QUERIES)])
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(columns, got.toArrow().to_pylist()) == rows(columns, [dict(zip(want.columns, r)) for r in want.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ten_operators_and_the_pipeline_are_there():
    llm = __spark_entry__._llm()
    if llm is not None:
        names = set(llm.queries())
        assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_merge_intervals_of_unknown_and_fractional_rows(spark, tmp_path):
    """Quantities round to the even neighbour and unknown places come last, as in the SQL; no two rows are alike, as it leaves the order of those open."""
    item = [(1, 1, None), (1, 1, 20.0), (1, 3, 5.0), (1, None, 7.0), (2, 2, 9.5), (2, 3, 3.0), (3, 2, 10.5), (3, 3, 3.0), (4, 1, 0.5), (4, 2, 1.5), (4, 3, -1.5)]
    item += [(5, None, None), (6, 1, None), (6, 1, 10.0), (6, 2, None), (None, 1, 2.5), (None, 1, 19.9), (None, None, 1.0), (7, 4, 1.0), (7, 5, 0.0), (7, 5, 2.0)]
    spark.createDataFrame(item, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = connection.sql(catalog.SQL["merge_intervals"])
    got = catalog.QUERIES["merge_intervals"](spark, str(tmp_path)).toArrow().to_pylist()
    assert rows(want.columns, got) == rows(want.columns, [dict(zip(want.columns, r)) for r in want.fetchall()])
