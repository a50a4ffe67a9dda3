"""Every registered query against its DuckDB SQL, and the rest of the library without the corpus subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import evidentia.plans.findings  # noqa: F401  adds its queries
import evidentia.plans.fusion  # noqa: F401  adds its queries
from evidentia.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            p = f"{SF}/{f}"
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert got.columns
        got.count()
        return
    cursor = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


def test_entry_and_registry_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'keyword_strings' in e.queries() and set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
