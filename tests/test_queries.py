"""Queries against DuckDB on the smallest tables, and golden cases of the metrics."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parlance.operators import history, metrics, speakers
from parlance.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_word_error_rate(spark):
    cases = [("a b c", "a b c", 0.0), ("a b c d", "a x c", 0.5), ("", "", 0.0), ("", "a", 1.0), ("Hello, WORLD", "hello world", 0.0), (" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(1, 400)), 1 / 400)]
    df = spark.createDataFrame(cases, "r string, h string, want double")
    for r in metrics.with_word_error_rate(df, "r", "h").collect():
        assert r.wer == pytest.approx(r.want)
    cer = spark.createDataFrame([("abcd", " ABXD ", 0.25), ("", "", 0.0), (None, "x", 1.0)], "r string, h string, want double")
    assert all(r.got == pytest.approx(r.want) for r in cer.withColumn("got", metrics.character_error_rate(F.col("r"), F.col("h"))).collect())


def test_diarization_errors(spark):
    ref = spark.createDataFrame([(1, "A", 0.0, 2.0), (1, "B", 2.5, 4.5)], "session_id long, speaker_id string, start_s double, end_s double")
    hyp = spark.createDataFrame([(1, "A", 0.0, 2.0), (1, "A", 2.5, 3.5), (1, "B", 3.5, 4.5)], ref.schema)
    r = metrics.diarization_errors(ref, hyp).first()
    assert r.speech == 200 and r.confused == 50 and r.missed == 0 and r.false_alarm == 0 and r.der == pytest.approx(0.25)


def test_history(spark):
    sessions = spark.createDataFrame([("a", 2, "First"), ("b", 1, "Second amigo")], "session_id string, created int, name string")
    caps = spark.createDataFrame([(1, "a", 0.0, 1.0, "una PELÍCULA", "x"), (2, "a", 1.0, 0.5, "bad", None), (3, "a", float("nan"), 2.0, "bad", None)], "id long, session_id string, start_s double, end_s double, original string, speaker_id string")
    found = lambda q: [(r.session_id, r.captions) for r in history.search(sessions, caps, q).collect()]
    assert found("amigo") == [("b", 0)] and found("película") == [("a", 3)] and found("") == [("a", 3), ("b", 0)] and found("' OR 1=1 --") == []
    assert history.valid(caps).count() == 1
    doc = history.export(caps.limit(1), "json").first().document
    assert doc.startswith('[{"start_s":0.0') and doc.endswith("]")
    with pytest.raises(ValueError):
        history.export(caps, "doc")


def test_words_and_sources(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b"], 0.9, 0.2, 0.1, 0.3)], "r array<string>, h array<string>, p double, q double, s double, t double")
    row = df.select(metrics.missing_words(F.col("r"), F.col("h")).alias("m"), speakers.swapped(F.col("p"), F.col("q"), F.col("s"), F.col("t")).alias("x")).first()
    assert row.m == ["a", "a"] and row.x is False
