from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from dutyframe.plans import asked, built, catalog, records, stored  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)[:-2] if str(v).endswith(".0") else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, sf, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_imports_without_the_corpus_operators():
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'on_call' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], timeout=120, check=False).returncode == 0


def test_rest_imports_without_the_corpus_folders(tmp_path):
    """In a copy without both folders and the pipeline's file the other queries are there."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "dutyframe", tmp_path / "dutyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e\nassert 'on_call' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120, check=False).returncode == 0
