"""Frames: resampling with a rest, audio around segments, two channels, limits; error cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.audio import Resampler, resample
from parlance.operators.metrics import diarization_errors
from parlance.operators.voice import padded, resampled
from parlance.streaming.capture import FRAMES, frames, mixed_channels, within_limit


def test_blocks_resample_like_the_whole(spark):
    x = np.sin(np.arange(4801) / 50).astype(np.float32)
    machine = Resampler(48000)
    got = np.concatenate([machine.add(x[i : i + 500]) for i in range(0, len(x), 500)])
    np.testing.assert_allclose(got, resample(x, 48000), atol=1e-6)
    assert len(machine.rest) == 1 and len(machine.add(np.zeros(0))) == 0
    odd = Resampler(44100)
    assert sum(len(odd.add(x[i : i + 500])) for i in range(0, 4410, 500)) >= 1440
    assert Resampler(16000, 2).add(np.array([0, 1, 2, 3], np.float32)).tolist() == [0.5, 2.5]
    df = spark.createDataFrame([(1, 1, [3.0, 3.0, 3.0, 9.0]), (1, 0, [0.0, 0.0]), (1, 2, None)], "session_id long, frame_seq long, samples array<float>")
    assert [(r.frame_seq, r.samples) for r in resampled(df, 48000).orderBy("frame_seq").collect()] == [(0, []), (1, [1.0, 5.0]), (2, [])]


def test_segments_with_what_came_before(spark):
    f = spark.createDataFrame([(1, k * 0.03, [float(k)] * 480) for k in range(20)], "session_id long, t_s double, samples array<float>")
    s = spark.createDataFrame([(1, 0, 0.45, [7.0] * 10), (1, 1, 0.03, [7.0] * 10), (1, 2, 0.0, [7.0]), (2, 0, 1.0, [7.0]), (1, 3, 0.3, []), (1, 4, 0.3, None)], "session_id long, segment long, start_s double, samples array<float>")
    got = {(r.session_id, r.segment): np.array(r.padded) for r in padded(s, f).collect()}
    want = np.concatenate([np.repeat(np.arange(5.0, 15.0), 480), np.full(10, 7.0), np.zeros(4800)])
    np.testing.assert_array_equal(got[1, 0], want)
    np.testing.assert_array_equal(got[1, 1], np.concatenate([np.zeros(4800), np.full(10, 7.0), np.zeros(4800)]))
    assert len(got[1, 2]) == 9601 and got[2, 0][4800] == 7.0 and len(got[1, 3]) == 0 and len(got[1, 4]) == 0


def test_two_channels_meet(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, frame_seq * 0.03)"
    base = spark.range(4).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("frame_seq")).withColumn("ts", F.expr(at))
    base.withColumn("samples", F.expr("array(0.5f, 0.9f, 0.1f)")).write.parquet(str(tmp_path / "a"))
    base.where("frame_seq > 0").withColumn("samples", F.expr("array(0.5f, 0.9f)")).write.parquet(str(tmp_path / "b"))
    both = mixed_channels(frames(spark, str(tmp_path / "a")), frames(spark, str(tmp_path / "b")))
    q = both.writeStream.format("memory").queryName("both").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    rows = spark.table("both").orderBy("frame_seq").collect()
    assert [r.frame_seq for r in rows] == [1, 2, 3] and rows[0].samples == pytest.approx([0.95, 1.0])


def test_a_backlog_stops_and_drops_nothing(spark):
    seen = []
    batch = spark.createDataFrame([(1, 0, None, [0.0] * 100), (1, 1, None, [0.0] * 100), (2, 0, None, [0.0] * 150)], FRAMES)
    within_limit(lambda df, n: seen.append(df.count()), rate=100, most_s=2.0)(batch, 0)
    with pytest.raises(RuntimeError):
        within_limit(lambda df, n: seen.append(df.count()), rate=100, most_s=1.9)(batch, 1)
    within_limit(lambda df, n: seen.append(df.count()))(batch.limit(0), 2)
    assert seen == [3, 0]


def test_error_cells_equal_those_counted_one_by_one(spark):
    rng = np.random.default_rng(3)

    def turns(n):
        start = rng.integers(0, 300, n) / 50
        return [(int(s), float(a), float(a + d), None if p == 3 else "ABC"[p]) for s, a, d, p in zip(rng.integers(0, 5, n), start, rng.integers(0, 80, n) / 50, rng.integers(0, 4, n), strict=True)]

    schema = "session_id long, start_s double, end_s double, speaker_id string"
    r, h = turns(40), turns(40)
    want = {}
    for session in {t[0] for t in r + h}:
        cells = []
        for side in (r, h):
            own = {}
            for _, a, b, p in sorted((t for t in side if t[0] == session), key=lambda t: (t[1], t[2], t[3] or "")):
                own.update(dict.fromkeys(range(int(np.floor(a / 0.02)), int(np.ceil(b / 0.02))), p))
            cells.append({c: p for c, p in own.items() if p})
        x, y = cells
        want[session] = (len(x), len(x.keys() - y.keys()), len(y.keys() - x.keys()), sum(x[c] != y[c] for c in x.keys() & y.keys()))
    got = diarization_errors(spark.createDataFrame(r, schema), spark.createDataFrame(h, schema)).collect()
    assert {g.session_id: (g.speech, g.missed, g.false_alarm, g.confused) for g in got} == want
    assert diarization_errors(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []
