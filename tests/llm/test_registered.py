"""Registered queries on the driver's tables: with SQL against DuckDB, the others by their contracts."""

import math
from pathlib import Path

import duckdb
import pytest

from folioscope.llm import queries as llm

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


def plain(rows, names):
    value = lambda x: round(x, 4) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(value(r[n]) for n in names) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, tables, name):
    df = llm.queries()[name](spark, str(DATA))
    said = tables.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    want = [dict(zip(columns, r, strict=True)) for r in said.fetchall()]
    assert sorted(df.columns) == sorted(columns) and plain(df.collect(), sorted(columns)) == plain(want, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs_over_whole_tables(spark, tables, name):
    rows = llm.queries()[name](spark, str(DATA)).collect()
    ids = sorted(r[0] for r in tables.execute("SELECT doc_id FROM documents").fetchall())
    assert sorted({r["doc_id"] for r in rows}) == sorted(set(ids)) and (name == "op1_packing" or len(rows) == len(ids))
