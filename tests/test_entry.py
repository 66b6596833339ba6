"""Every DuckDB text goes with a query, and quick ones agree."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_texts_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["cell_fit", "cell_merge", "nearest_cell", "asof_pose", "pose_chain", "particle_resampling"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want, got = c.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))
