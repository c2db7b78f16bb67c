"""Every query that has SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}
#: Needs more sessions in the universe than the smallest tables have.
LARGER = {"cv_folds"}


@pytest.fixture(scope="module")
def duck():
    found = {}

    def at(folder):
        if folder not in found:
            con = found[folder] = duckdb.connect()
            for f in glob.glob(f"{folder}/*.parquet"):
                con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        return found[folder]

    return at


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else sf_dir
    got = entry.queries()[name](spark, folder)
    want = duck(folder).execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_callable_and_named_once():
    names = list(entry.queries())
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)
