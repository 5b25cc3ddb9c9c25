"""Every registered query of the main library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lodeworks.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert cols == sorted(names)
    mine = sorted((tuple(plain(x[c]) for c in cols) for x in rows), key=repr)
    other = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert mine == other


def test_partitioning_changes_nothing(spark):
    from lodeworks.plans import catalogue as c

    chunks = c.chunk_table(spark, DATA)
    probe = c.probe(spark, DATA)
    from lodeworks.operators.retrieval import retrieve

    one = retrieve(chunks.coalesce(1), probe, c.TERMS, 6, c.FLOOR).select("id", "final_rank").collect()
    many = retrieve(chunks.repartition(7), probe, c.TERMS, 6, c.FLOOR).select("id", "final_rank").collect()
    assert sorted(one) == sorted(many)
