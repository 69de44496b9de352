"""The history store: sessions, states, captions, newer columns, batches written twice."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from parlance.operators import history
from parlance.sources.history import HistoryStore
from parlance.sources.tables import glossary, glossary_json, with_term, without_term
from parlance.streaming.capture import FRAMES, lossy


def test_sessions_and_captions(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    assert store.sessions().count() == 0 and store.captions().count() == 0 and store.orphans().count() == 0
    at = [datetime(2024, 1, d, tzinfo=UTC) for d in (1, 2, 3)]
    a = store.create("first", "live", "en", "es", "base", at[0])
    b = store.create("second", "file", None, "pt", "small", at[1])
    store.add(a, [(0.0, 1.0, "hello", "hola", "en", "S1"), (1.0, 2.0, "bye", "adiós", "en", None)])
    store.add(a, [(2.0, 3.0, "again", "otra vez", "en", "S1")])
    store.add(a, [])
    with pytest.raises(ValueError):
        store.add(a, [(2.0, 2.0, "x", "x", "en", None)])
    with pytest.raises(ValueError):
        store.add(a, [(float("nan"), 2.0, "x", "x", "en", None)])
    assert [(r.id, r.original, r.speaker_id) for r in store.captions(a).collect()] == [(0, "hello", "S1"), (1, "bye", None), (2, "again", "S1")]
    assert store.captions(a, 2).count() == 2 and store.captions(b).count() == 0
    assert {r.session_id: r.state for r in store.sessions().collect()} == {a: "en curso", b: "en curso"}
    store.finish(a, "completado", at[2])
    store.finish(a, "error", at[0])
    assert {r.session_id: r.state for r in store.sessions().collect()} == {a: "completado", b: "en curso"}
    found = history.search(store.sessions(), store.captions(), "BYE").collect()
    assert [(r.session_id, r.captions) for r in found] == [(a, 3)]
    store.add("nowhere", [(0.0, 1.0, "x", "y", "en", None)])
    assert [r.session_id for r in store.orphans().collect()] == ["nowhere"]


def test_older_files_lack_newer_columns(spark, tmp_path):
    spark.createDataFrame([("s", 0, 0.0, 1.0, "a", "b", "en")], "session_id string, id long, start_s double, end_s double, original string, translated string, language string").write.parquet(str(tmp_path / "captions"))
    store = HistoryStore(spark, str(tmp_path))
    store.add("s", [(1.0, 2.0, "c", "d", "en", "S1")])
    assert [(r.id, r.speaker_id) for r in store.captions("s").collect()] == [(0, None), (1, "S1")]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("s", i, float(i), i + 1.0, "a", "b", "en", None) for i in range(4)], "session_id string, id long, start_s double, end_s double, original string, translated string, language string, speaker_id string")
    write = store.sink()
    write(rows.where("id < 2"), 0)
    write(rows.where("id >= 2"), 1)
    write(rows.where("id >= 2"), 1)
    assert [r.id for r in store.captions("s").collect()] == [0, 1, 2, 3]


def test_a_lossy_queue_counts_what_it_drops(spark):
    seen, dropped = [], spark.sparkContext.accumulator(0)
    batch = spark.createDataFrame([(s, i, None, [0.0]) for s in (1, 2) for i in range(3 * s)], FRAMES)
    lossy(lambda df, n: seen.append(sorted((r.session_id, r.frame_seq) for r in df.collect())), 4, dropped)(batch, 0)
    assert seen == [[(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]] and dropped.value == 2


def test_glossary_edits():
    g = with_term({"a": "b"}, " Chat ", " GPT ")
    assert g == {"a": "b", "Chat": "GPT"} and with_term(g, " ", "x") == g and without_term(g, "a ") == {"Chat": "GPT"} and without_term(g, "z") == g
    assert glossary(glossary_json(g)) == g
