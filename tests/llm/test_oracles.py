from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from scholia.llm import queries
from scholia.llm.oracles import SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
