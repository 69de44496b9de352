"""Segments on their way, scripts of a dialogue, gains, speakers with names."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parlance.functions import arrays
from parlance.functions.text import clean_source
from parlance.operators import context, duplicates, evaluate, routing, speakers


def test_segments_are_clamped_numbered_and_sent_on(spark):
    c = spark.createDataFrame([(0, -1.0, 5.0), (1, 29.0, 40.0), (2, 31.0, 40.0), (3, 4.0, 4.0)], "id int, start_s double, end_s double").withColumns({"chunk_start_s": F.lit(30.0), "chunk_end_s": F.lit(60.0)})
    assert [(r.id, r.start_s, r.end_s) for r in routing.clamped(c).orderBy("id").collect()] == [(0, 30.0, 35.0), (1, 59.0, 60.0)]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("de",)], "l string").select(routing.known_language(F.col("l"))).collect()
    t = np.arange(16000) / 16000
    two = (0.4 * np.sin(2 * np.pi * 120 * t) + 0.4 * np.sin(2 * np.pi * 197 * t)).astype(np.float32).tolist()
    rows = [(1, 2.0, 1.0, 2.0, two), (1, 1.0, 0.0, 1.0, [0.0] * 16000), (2, 9.0, 0.0, 1.0, None)]
    s = routing.presegmented(spark.createDataFrame(rows, "session_id long, captured_s double, start_s double, end_s double, samples array<float>"))
    apart, rest = routing.routed(s)
    assert [(r.session_id, r.sequence_id, r.is_overlap) for r in apart.collect()] == [(1, 2, True)]
    assert sorted((r.session_id, r.sequence_id) for r in rest.collect()) == [(1, 1), (2, 1)]
    full = spark.createDataFrame([(True, True), (True, False), (None, None)], "o boolean, f boolean").select(routing.destination(F.col("o"), F.col("f")).alias("d"))
    assert [r.d for r in full.collect()] == ["recognition", "separation", "recognition"]


def test_subtitles_have_latencies(spark):
    df = spark.createDataFrame([("uno dos", 1.0, 2.5, 0.5, None), ("x", 3.0, 2.0, None, 0.25)], "translated string, captured_s double, shown_s double, asr_s double, translation_s double")
    got = [(r.subtitle, r.total_latency, r.asr_latency, r.trans_latency) for r in routing.subtitles(df).collect()]
    assert got == [("uno dos", 1.5, 0.5, 0.0), ("x", 0.0, 0.0, 0.25)]


def test_scripts(spark):
    c = spark.createDataFrame([(1, i, "AB"[i % 2], f"t{i}", 10.0 * i) for i in range(5)], "session_id long, id long, speaker_id string, original string, start_s double")
    got = [r.script for r in context.as_script(c, 3, 15.0).orderBy("id").collect()]
    assert got[0] == "[A]: t0" and got[4] == "[B]: t3\n[A]: t4"
    assert [r.context for r in context.last_turns(c.withColumn("end_s", F.col("start_s")), 2, own=True).orderBy("id").collect()][-1] == ["t3", "t4"]
    assert context.vocabulary({"__note": "x", "b": "c", "a": "d"}) == "Vocabulary: b, a." and context.vocabulary({"__x": "y"}) is None
    df = spark.createDataFrame([("The  Cat, cat-like concat",), (None,)], "t string").select(clean_source(F.col("t"), {"cat": "dog", "the": "thé", "": "x"}).alias("t"))
    assert [r.t for r in df.collect()] == ["The dog, dog-like concat", ""]


def test_gains_and_margins(spark):
    df = spark.createDataFrame([([0.1, -0.2],), ([0.0005],), ([0.5],), ([],), (None,), ([2.0, -2.0],)], "s array<float>")
    got = df.select(arrays.raised(F.col("s")).alias("r"), arrays.pcm16(F.col("s")).alias("p")).collect()
    assert got[0].r == pytest.approx([0.3, -0.6]) and got[1].r == pytest.approx([0.0005]) and got[2].r == [0.5] and got[3].r == [] and got[4].r is None
    assert got[5].p == [32767, -32767] and got[0].p[0] == int(np.float32(0.1) * 32767.0) and got[4].p is None
    one = df.limit(1).select(arrays.with_margins(F.array_repeat(F.lit(1.0), 100), F.lit(5.0), F.lit(4.0), F.lit(5.2), 0.1, 0.3, 100).alias("a"), arrays.with_margins(F.array_repeat(F.lit(1.0), 100), F.lit(5.0), F.lit(None).cast("double"), F.lit(5.2), rate=100).alias("b")).first()
    assert (len(one.a.samples), one.a.start_s, one.a.end_s) == (50, 5.0, 5.5) and (len(one.b.samples), one.b.end_s) == (100, 6.0)


def test_speakers_with_names(spark):
    known = spark.createDataFrame([("SPEAKER_02", [1.0, 0.0]), ("SPEAKER_01", [1.0, 0.0]), ("SPEAKER_03", [0.0, 1.0])], "speaker string, centroid array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.speaker, r.score, r.second) for r in speakers.match(v, known).collect()) == [(1, "SPEAKER_01", 1.0, 1.0), (2, "SPEAKER_03", 1.0, 0.0)]


def test_a_row_without_confidence_can_be_chosen(spark):
    rows = [(1, 1, "A", "one two three four", 0.0, 1.0, None), (1, 1, "B", "one two three", 0.1, 1.0, None)]
    got = duplicates.resolve_channels(spark.createDataFrame(rows, "session_id long, sequence_id long, speaker_id string, text string, start_s double, end_s double, confidence double")).collect()
    assert [r.speaker_id for r in got] == ["A"]


def test_common_words_in_order_equal_the_table():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (["abcdefg"[k] for k in rng.integers(0, rng.integers(1, 8), rng.integers(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert evaluate.common_length(a, b) == row[-1]


def test_bounds_decide_like_the_similarity():
    rng = np.random.default_rng(7)
    words = "one two three four five six seven".split()
    for _ in range(400):
        a, b = (" ".join(words[k] for k in rng.integers(0, 7, rng.integers(0, 9))) for _ in range(2))
        for least in (0.3, duplicates.ALIKE, duplicates.SUPPRESS, 0.9, 1.0):
            assert duplicates.alike(a, b, least) == (duplicates.similarity(a, b) >= least)
