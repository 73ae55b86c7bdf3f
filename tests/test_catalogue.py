"""Every catalogue query equals its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    return "null" if value is None or value != value else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    rows = [tuple(r[c] for c in names) for r in frame.collect()]
    assert rows
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = [tuple(r[columns.index(c)] for c in names) for r in found.fetchall()]
    assert sorted(columns) == names
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_without_the_corpus_operators(tmp_path):
    """The driver's entry module works where tessera.llm and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and 'd1_duplicates' in q and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
