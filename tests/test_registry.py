"""Every registered query of the trip engine against its SQL in DuckDB, on the small tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wayloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(str(tuple(map(norm, r))) for r in got.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert rows == sorted(str(tuple(map(norm, r))) for r in want)


def test_entry_works_without_the_corpus_package(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "wayloom", tmp_path / "wayloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_pois' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
