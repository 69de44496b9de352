"""Speakers over time, cuts where the voice changes, separation of two voices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.audio import RATE
from parlance.operators.separation import by_harmonics, scores, separate, verdict
from parlance.operators.tracking import Tracker, cut_points, pieces, track
from parlance.streaming.tracking import track_stream


def tone(f: float, seconds: float, level: float = 0.3) -> np.ndarray:
    t = np.arange(int(seconds * RATE)) / RATE
    return (level * sum(np.sin(2 * np.pi * k * f * t) / k for k in (1, 2, 3, 4))).astype(np.float32)


def unit(*x: float) -> np.ndarray:
    return np.array(x) / np.linalg.norm(x)


X, Y, Z = unit(1, 0, 0), unit(0, 1, 0), unit(0, 0, 1)


def test_speakers_are_numbered_as_they_come():
    t = Tracker()
    heard = [t.hear(v, 0, s, s + 1.0)[0] for s, v in enumerate((X, X, Y, X, Z, Y))]
    assert heard == ["SPEAKER_01", "SPEAKER_01", "SPEAKER_02", "SPEAKER_01", "SPEAKER_03", "SPEAKER_02"]


def test_short_and_unclean_segments_make_no_speaker_at_once():
    t = Tracker()
    t.hear(X, 0, 0, 1)
    assert t.hear(Y, 0, 2, 2.3) == ("SPEAKER_01", 0.0, False)
    assert t.hear(Y, 0, 3, 4, clean=False)[0] == "SPEAKER_01"
    assert t.hear(Z, 0, 5, 6, clean=False)[0] == "SPEAKER_01"
    assert t.hear(Z, 0, 7, 8, clean=False) == ("SPEAKER_02", 1.0, True)
    assert t.hear(None, 0, 9, 10)[0] == "SPEAKER_02"


def test_who_spoke_last_has_a_bonus_that_fades():
    near = unit(0.54, np.sqrt(1 - 0.54**2), 0)
    for gap, speaker in ((0.0, "SPEAKER_01"), (2.0, "SPEAKER_02")):
        t = Tracker()
        t.hear(X, 0, 0, 1)
        assert t.hear(near, 0, 1 + gap, 2 + gap)[0] == speaker


def test_pitch_tells_like_voices_apart():
    near = unit(0.7, np.sqrt(1 - 0.49), 0)
    for f, speaker in ((122.0, "SPEAKER_01"), (190.0, "SPEAKER_02")):
        t = Tracker()
        t.hear(X, 120.0, 0, 1)
        assert t.hear(near, f, 5, 6)[0] == speaker


def test_pairs():
    assert [p[0] for p in Tracker().pair(X, Y)] == ["SPEAKER_01", "SPEAKER_02"]
    t = Tracker()
    t.hear(X, 0, 0, 1)
    assert [(p[0], p[3]) for p in t.pair(Y, X)] == [("SPEAKER_02", True), ("SPEAKER_01", False)]
    assert [p[0] for p in t.pair(Y, X)] == ["SPEAKER_02", "SPEAKER_01"]
    assert [p[0] for p in t.pair(X, Y)] == ["SPEAKER_01", "SPEAKER_02"]
    assert [p[0] for p in t.pair(X, unit(1, 0.1, 0))] == ["SPEAKER_01", "SPEAKER_01"]
    assert [p[0] for p in t.pair(None, None)] == ["SPEAKER_01", "SPEAKER_02"]


def test_cuts_where_the_voice_changes():
    audio = np.concatenate([tone(110, 1.0), np.zeros(RATE * 3 // 10, np.float32), tone(230, 1.0, 0.6), np.zeros(RATE // 5, np.float32), tone(110, 1.0)])
    words = [("a", 0.0, 1.0), ("b", 1.3, 2.3), ("c", 2.5, 3.5)]
    assert cut_points(audio, words) == [0, 1]
    assert cut_points(audio, [("a", 0.0, 1.25), ("b", 1.3, 3.5)]) == []
    assert cut_points(tone(110, 3.5), words) == []


def test_segments_to_speakers_in_batch_and_stream(spark, tmp_path):
    both = np.concatenate([tone(110, 1.0), np.zeros(RATE // 5, np.float32), tone(230, 1.0)])
    words = [{"word": "first", "start": 0.0, "end": 1.0}, {"word": "second", "start": 1.2, "end": 2.2}]
    rows = [
        (1, 0, 0.0, 2.2, "first second", both.tolist(), words, True, None),
        (1, 1, 3.0, 4.0, "third", tone(110, 1.0).tolist(), None, True, None),
        (1, 2, 5.0, 6.0, None, None, None, None, None),
        (2, 0, 0.0, 1.0, "left", tone(110, 1.0).tolist(), None, True, 0),
        (2, 0, 0.0, 1.0, "right", tone(230, 1.0).tolist(), None, True, 1),
    ]
    words_type = "array<struct<word: string, start: double, end: double>>"
    segments = spark.createDataFrame(rows, f"session_id long, segment long, start_s double, end_s double, text string, samples array<float>, words {words_type}, clean boolean, source int")
    cut = pieces(segments)
    got = [(r.session_id, r.segment, r.piece, r.source, r.text, r.speaker_id) for r in track(cut).orderBy("session_id", "segment", "piece", "source").collect()]
    assert got == [
        (1, 0, 0, None, "first", "SPEAKER_01"), (1, 0, 1, None, "second", "SPEAKER_02"), (1, 1, 0, None, "third", "SPEAKER_01"), (1, 2, 0, None, None, "SPEAKER_01"),
        (2, 0, 0, 0, "left", "SPEAKER_01"), (2, 0, 0, 1, "right", "SPEAKER_02"),
    ]
    assert track(cut.limit(0)).collect() == []
    for k in range(3):
        cut.where(F.col("segment") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = track_stream(spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tracked").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    assert sorted((r.session_id, r.segment, r.piece, r.source, r.text, r.speaker_id) for r in spark.table("tracked").collect() if r.session_id == 1) == sorted(got[:4])


def test_two_tones_come_apart():
    low, high = tone(125, 1.0), tone(281.25, 1.0, 0.2)
    first, second = by_harmonics(low + high)
    np.testing.assert_allclose(first + second, low + high, atol=1e-4)
    like = lambda a, b: abs(float(np.corrcoef(a, b)[0, 1]))
    assert {like(first, low) > like(first, high), like(second, low) > like(second, high)} == {True, False}


@pytest.mark.parametrize(
    "values, want",
    [((100, 900, 0.1, 0.1, None, None, None), "short"), ((900, 900, 0.001, 0.002, 0.0, 0.0, 0.0), "quiet"), ((900, 900, 0.1, 0.007, 0.0, 0.0, 0.0), "leak"), ((900, 900, 0.1, 0.1, 0.6, 0.0, 0.0), "same_wave"),
     ((900, 900, 0.1, 0.1, 0.1, 0.9, 0.7), "same_voice"), ((900, 900, 0.1, 0.1, 0.1, 0.1, 0.72), "same_voice"), ((900, 900, 0.1, 0.1, 0.1, 0.9, 0.5), "two_voices")],
)
def test_verdicts(spark, values, want):
    s = spark.createDataFrame([(values,)], "s struct<samples0: int, samples1: int, level0: double, level1: double, correlation: double, spectrum: double, voice: double>")
    assert s.select(verdict(F.col("s"))).first()[0] == want


def test_separation_keeps_what_fails(spark):
    mixed = (tone(125, 1.0) + tone(281.25, 1.0, 0.25)).tolist()
    rows = [(1, mixed, True), (2, mixed, False), (3, None, True), (4, mixed, None), (5, [0.0] * 2000, True)]
    segments = spark.createDataFrame(rows, "segment int, samples array<float>, is_overlap boolean")
    low, high = tone(110, 1.0), tone(237, 1.0)
    parts = lambda a: (low, high) if len(a) > 5000 else by_harmonics(a)
    got = {(r.segment, r.source): r.verdict for r in separate(segments, lambda: parts).collect()}
    kinds = {v for (k, _), v in got.items() if k == 1}
    assert got[2, None] is None and got[3, None] == "short" and got[4, None] is None and got[5, None] == "quiet" and len(kinds) == 1
    assert scores(tone(110, 1.0), tone(110, 1.0))[4] > 0.99

    def broken(a):
        raise ValueError

    assert {(r.segment, r.verdict) for r in separate(segments.where("segment = 1"), lambda: broken).collect()} == {(1, "failed")}
