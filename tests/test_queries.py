from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from scholia.plans.queries import QUERIES, SQL

DATA = Path(__spark_entry__.SMOKE)
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    want = tables.execute(SQL[name])
    order = sorted(range(len(want.description)), key=lambda k: want.description[k][0])
    assert sorted(d[0] for d in want.description) == columns
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "line", "end_line", "message"]
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
