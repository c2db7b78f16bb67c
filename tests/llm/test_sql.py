"""The corpus queries that SQL can express, held against DuckDB; all of them, run."""

import glob
import os

import duckdb
import pytest

from tapeloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    assert rows
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, want.fetchall()))
    else:
        n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
        assert len(rows) == n and len({r["doc_id"] for r in rows}) == n
