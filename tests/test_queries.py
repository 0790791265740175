"""Every registered query on the smallest tables against its SQL, and the package's seams."""

import glob
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from coalis.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, float) else str(v)

    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    theirs = duck.execute(registry.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.collect(), df.columns) == comparable(theirs.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_core_does_not_import_llm():
    code = "import sys, __spark_entry__; sys.modules.pop('coalis.llm', None)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
    for source in (ROOT / "coalis").rglob("*.py"):
        if "llm" not in source.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", source.read_text(), re.M), source


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for name in ("coalis", "tests", "__spark_entry__.py", "bench.py", "key_contexts.json"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.is_file():
            shutil.copy(source, tmp_path / name)
    assert not (tmp_path / "coalis" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, timeout=300, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stdout[-2000:]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from coalis.streaming.exact import correlation_counts, new_occurrences

    rows = [("a", "2024-01-01 00:00:00", ["k1"]), ("a", "2024-01-01 00:10:00", ["k1", "k2"]), ("b", "2024-01-01 00:20:00", [])]
    df = spark.createDataFrame(rows, "occurrence_key string, received_at string, correlation_keys array<string>").withColumn("received_at", F.to_timestamp("received_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("fresh", new_occurrences(stream), "append"), ("counts", correlation_counts(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r[0] for r in spark.table("fresh").select("occurrence_key").collect()) == ["a", "b"]
    assert sorted((r["key"], r["n"]) for r in spark.table("counts").collect()) == [("k1", 2), ("k2", 1)]
