from __future__ import annotations

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from tagweave.operators.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def text(v):
    return None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    run, sql = CATALOG[name]
    got = run(spark, SF)
    if sql is None:
        assert got.count() > 0
        return
    want = con.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(str([text(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(str([text(v) for v in r]) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_without_the_subpackage():
    """The entry module works when the training-data subpackage and its pipeline are absent."""
    import subprocess

    code = "import sys; sys.modules['tagweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry_module.__file__), capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(CATALOG) and out[1] == "False"
