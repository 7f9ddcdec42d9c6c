"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import datetime
import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in CORE if n in ORACLE])
def test_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    order = [list(relation.columns).index(c) for c in columns]
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got == sorted([plain(r[k]) for k in order] for r in relation.fetchall())


@pytest.mark.parametrize("name", [n for n in CORE if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "s", "p", "o", "datatype"]


def test_without_training_data_operators(tmp_path):
    """The rest stands alone where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "weftgraph"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else os.mkdir(tmp_path / name)
    for name in os.listdir(f"{root}/weftgraph"):
        if name != "llm":
            os.symlink(f"{root}/weftgraph/{name}", tmp_path / "weftgraph" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 40 and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_without_the_matching_library(tmp_path):
    """A library that only training-data operators need may be missing: the other queries stay."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not installed')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {root!r}]; import __spark_entry__ as e; assert len(e.queries()) > 40 and not set(e.oracle_sql()) - set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)
