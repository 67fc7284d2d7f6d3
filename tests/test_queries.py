"""Queries against their SQL, and the entry's contract."""

import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = list(got.columns)
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["run_id", "t", "kind", "k", "value"] and got.count() > 0


def test_entry_without_the_training_data_package(tmp_path):
    """With the llm folders and the pipeline gone, the rest imports and keeps its queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/panelforge", tmp_path / "panelforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q), q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_fits_may_run_until_they_converge(monkeypatch):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from panelforge import queries

    asked = {}
    monkeypatch.setattr(queries, "models", SimpleNamespace(params_df=MagicMock(), fit_df=lambda *a, **k: asked.update(k) or MagicMock()))
    monkeypatch.setattr(queries, "_dense_by_region", MagicMock())
    monkeypatch.setattr(queries, "F", MagicMock())
    queries.QUERIES["fit_regions"](None, "")
    assert asked["max_steps"] >= 500  # the reference's limit for a whole estimation


def test_rounding_of_large_ratios(spark, tmp_path):
    """Ratios with as many digits as a double holds round as in SQL: here Spark's own rounding gives another last digit."""
    rows = [(0, 120001134, 54.81), (1, 130001494, 81.58), (2, 220000345, 104.23), (3, 10**12 + 7, 60.13), (4, 235, 29.27), (5, 5 * 10**9, 51.27), (6, 5, 128.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT event_id, kept, ratio, present, across FROM ({queries.SQL['guarded_arithmetic']})").fetchall()
    got = queries.QUERIES["guarded_arithmetic"](spark, str(tmp_path)).select("event_id", "kept", "ratio", "present", "across").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_rounding_leaves_what_it_can_not_scale(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (1e305,), (-2.5,), (-0.0,)], "x double").select(queries._r("x", 0).alias("a"), queries._r("x").alias("b"))
    assert [str(r["b"]) for r in df.collect()] == ["inf", "nan", "None", "1e+305", "-2.5", "0.0"] and df.collect()[4]["a"] == -3.0
