"""Every query with SQL against another engine, on the smallest tables; all others give rows of a stable shape."""

from __future__ import annotations

import math

import pytest

from hecespark.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_sql_gives_the_same(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    result = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, got) == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", ["parse_tokens", "clitic_split_tokens", "normalize_surface", "normalize_morphemes", "normalize_jsonl", "normalize_summary", "tokenize_text", "suggester_bench", "fertility_morphemes"])
def test_other_queries_run(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry point imports where the pipeline and its subpackage are not there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "hecespark", tmp_path / "hecespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
