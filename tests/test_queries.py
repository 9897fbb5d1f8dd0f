"""Differential check: every registered query vs its DuckDB oracle (sf0.001),
plus the driver entry point."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_mod  # noqa: E402
from compare import digest, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry_mod.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "EM" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    oracle = entry_mod.oracle_sql().get(name)
    if oracle is None:
        pytest.skip("no SQL oracle")
    cur = con.execute(oracle)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    dtypes = dict(zip(dcols, [str(t) for t in cur.description and con.sql(oracle).types]))
    for f in df.schema.fields:
        assert types.get(f.dataType.simpleString()) == dtypes[f.name], (f.name, f.dataType, dtypes[f.name])
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
