"""Every corpus query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from meterstream.llm import queries
from tests.test_registry import DATA, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} >= {f"op{k}" for k in range(1, 11)} and set(queries.ORACLES) <= set(queries.QUERIES)


def test_coverage_encodes_texts_once(spark):
    """Pieces are read from a table by both sides of the join, not made for each."""
    from meterstream.llm import queries

    plan = queries.packing_coverage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan parquet" in plan
