"""State machines in batch and in streams, and their golden cases."""

import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import assembly, duplicates, tracking, voice
from parlance.operators.assembly import Assembler
from parlance.plans.queries import fragments
from parlance.sources.tables import wav_chunks
from parlance.streaming.assembly import assemble_stream
from parlance.streaming.drain import drain
from parlance.streaming.duplicates import suppress_stream
from parlance.streaming.voice import detect_stream

A, B = "SPEAKER_01", "SPEAKER_02"


def test_fragments_join_until_the_text_is_complete():
    m = Assembler()
    assert m.add(A, "I was really nervous", 0, 1, 80, True) == []
    assert m.add(A, "coming in here", 1.08, 2, 100, True) == []
    (u,) = m.add(A, "because this means a lot to me.", 2.1, 3.4, 700)
    assert u["fragments"] == 3 and u["complete"] and u["start_s"] == 0 and u["end_s"] == 3.4


def test_speakers_are_kept_apart():
    m = Assembler()
    first = m.add(A, "I think that's...", 0, 0.8, 100)
    second = m.add(B, "Exactly.", 0.9, 1.4, 700)
    assert first == [] and [(u["speaker_id"], u["interrupted"]) for u in second] == [(A, True), (B, False)]
    m = Assembler()
    out = m.add(A, "A begins because", 0, 1) + m.add(B, "B interrupts.", 1, 2) + m.add(A, "A returns.", 2, 3) + m.flush()
    assert [u["text"] for u in out] == ["A begins because", "B interrupts.", "A returns."]


def test_dots_join_and_pauses_part():
    m = Assembler()
    assert m.add(A, "I think...", 0, 0.8, 200) == []
    assert [u["text"] for u in m.add(A, "this is really important.", 1, 2, 700)] == ["I think... this is really important."]
    m = Assembler()
    m.add(A, "This clause is complete", 0, 0.8, 300)
    out = m.add(A, "This is another sentence.", 2, 3, 700)
    assert [(u["text"], u["reason"]) for u in out] == [("This clause is complete", "acoustic_gap"), ("This is another sentence.", "completion_score")]


def test_progress_closes_complete_clauses_only():
    m = Assembler()
    m.add(A, "This clause is complete", 0, 0.8, 300)
    assert m.progress(0.9, 0.5) == [] and m.progress(5.0, 2.0) == []
    assert [u["reason"] for u in m.progress(1.5, 0.5)] == ["timeout"]
    m.add(A, "I was thinking about", 2, 2.8, 600)
    assert m.progress(6.0, 2.2) == []
    assert [u["complete"] for u in m.add(A, "what you said.", 6, 7, 700)] == [True]


def test_batch_and_stream_give_the_same(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = fragments(spark, folder)
    want = sorted(map(repr, assembly.assemble(rows).collect()))
    ordered = rows.toPandas().sort_values(["sequence_id", "session_id"])
    path = str(tmp_path / "in")
    schema = rows.schema
    for k, part in enumerate(np.array_split(ordered, 3)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    ends = ordered.groupby("session_id", as_index=False).first().assign(text=None, sequence_id=10**9, is_partial=False)
    spark.createDataFrame(ends[list(ordered.columns)].astype({"text": object}), schema).coalesce(1).write.parquet(f"{path}/9")
    got: list[str] = []
    for k in (0, 1, 2, 9):  # one micro-batch each
        spark.read.parquet(f"{path}/{k}").coalesce(1).write.mode("append").parquet(f"{path}/all")
        stream = assemble_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all"))
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted(map(repr, spark.read.parquet(f"{path}/out").select(*assembly.COLUMNS).collect()))
    assert got == want


def test_voice_segments(spark):
    def frames(levels):
        return [(480, x) for x in levels]

    d = voice.Detector(threshold=0.02, silence_ms=210, preroll=2)
    out = [s for f in frames([0] * 5 + [0.1] * 10 + [0] * 10) for s in d.add(*f)] + d.flush()
    assert [(s["reason"], round(s["start_s"], 3), s["samples"], s["trailing_ms"]) for s in out] == [("silence", 0.09, 19 * 480, 210)]
    assert d.progress() == {"reason": "progress", "processed_s": 25 * 0.03, "voice_s": pytest.approx(15 * 0.03)}
    short = voice.Detector(threshold=0.02, silence_ms=60, preroll=0)
    assert [s for f in frames([0.1] * 2 + [0] * 5) for s in short.add(*f)] + short.flush() == []
    long = voice.Detector(threshold=0.02, most_s=0.24, preroll=0, least_ms=0)
    out = [s for f in frames([0.1 + 0.01 * i for i in range(12)]) for s in long.add(*f)] + long.flush()
    assert sum(s["samples"] for s in out) == 12 * 480 and out[-1]["end_s"] == pytest.approx(0.36)
    # The quietest of the last four of eight frames closes the first part; the pause before it counts no more.
    valley = voice.Detector(threshold=0.02, most_s=0.24, silence_ms=120, preroll=0, least_ms=0)
    out = [s for f in frames([0.1, 0.01, 0.1, 0.1, 0.1, 0.05, 0.1, 0.1, 0.1, 0, 0, 0, 0]) for s in valley.add(*f)] + valley.flush()
    assert [(s["reason"], s["samples"] // 480, s["start_s"]) for s in out] == [("max_duration", 6, 0.0), ("silence", 7, pytest.approx(0.18))]
    assert voice.Detector().add(0, 0.0) == [] and voice.options_of("natural", threshold=1) == {"silence_ms": 800, "threshold": 1}
    rows = [(1, i, [x] * n) for i, (n, x) in enumerate(frames([0.1] * 20 + [0.0] * 30))] + [(2, 0, [0.0] * 480), (2, 1, None)]
    df = spark.createDataFrame(rows, "session_id long, frame_seq long, samples array<float>").orderBy(F.rand(1))
    got = voice.detect(df, silence_ms=300).collect()
    assert [(r.session_id, r.segment, r.reason, r.samples) for r in got] == [(1, 0, "silence", 30 * 480)]


def test_voice_in_batch_and_stream(spark, tmp_path):
    """Segments of a stream cut anywhere are those of the batch, and progress tells how far each session was heard."""
    rng = np.random.default_rng(4)
    rows = [(s, i, [float(0.1 * (rng.random() < 0.6))] * 160) for s in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "session_id long, frame_seq long, samples array<float>")
    options = {"silence_ms": 40, "most_s": 0.4, "least_ms": 30, "preroll": 2}
    want = voice.detect(df, progress=True, **options)
    kept = ("session_id", "segment", "start_s", "end_s", "samples", "reason", "trailing_ms")
    bounds = [0, 7, 50, 51, 120]
    for a, b in zip(bounds, bounds[1:]):
        df.where(f"frame_seq >= {a} and frame_seq < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("frame_seq = 0").selectExpr("session_id", "frame_seq + 120 as frame_seq", "cast(null as array<float>) as samples").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **options)
    drain([("voice", lambda: stream.writeStream.format("memory").queryName("voices").option("checkpointLocation", str(tmp_path / "cp")))], 120)
    got = spark.table("voices")
    rows = lambda d: sorted(map(repr, d.where("reason <> 'progress'").select(*kept).collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 4
    last = {r.session_id: (r.p, r.v) for r in got.groupBy("session_id").agg(F.max("processed_s").alias("p"), F.max("voice_s").alias("v")).collect()}
    assert last == {r.session_id: (r.processed_s, r.voice_s) for r in want.where("reason = 'progress'").collect()}


def test_repeats_in_batch_and_stream(spark, tmp_path):
    words = "one two three four five six seven eight".split()
    rng = np.random.default_rng(8)
    rows = [(1, "AB"[int(rng.integers(2))], " ".join(words[k : k + 5]), round(0.4 * i, 1), round(0.4 * i + 1, 1)) for i in range(60) for k in [int(rng.integers(4))]]
    df = spark.createDataFrame(rows, "session_id long, speaker_id string, text string, start_s double, end_s double")
    want = sorted(map(repr, duplicates.suppress_repeats(df).collect()))
    for a, b in ((0, 5), (5, 16), (16, 25)):
        df.where(f"start_s >= {a} and start_s < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = suppress_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    drain([("repeats", lambda: stream.writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "cp")))], 120)
    assert sorted(map(repr, spark.table("repeats").collect())) == want and 10 < len(want) < 55


def test_a_stage_that_takes_too_long_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    writer = lambda: rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp"))
    with pytest.raises(TimeoutError, match="first"):
        drain([("first", writer)], 0.001)


def test_state_survives_as_json():
    m = Assembler()
    m.add(A, "I want to", np.float64(0.0), 1.0, 300, True, 0.5, [("I", 0.0, 0.1)], 3, 0.25, 7.0, True)
    again = Assembler.of(m.state())
    assert again.state() == m.state()
    (out,) = again.add(A, "go home.", 1.0, 2.0, 900, sequence=4, asr_s=0.5, captured_s=6.0)
    assert (out["text"], out["asr_s"], out["captured_s"], out["is_overlap"]) == ("I want to go home.", 0.75, 7.0, True)
    t = tracking.Tracker()
    x, y = np.eye(4)[0], np.eye(4)[1]
    t.hear(x, 120.0, 0, 1)
    t.hear(y, 0.0, 1, 1.5, False)
    u = tracking.Tracker.of(t.state())
    assert u.state() == t.state() and u.hear(x, 118.0, 2, 3) == t.hear(x, 118.0, 2, 3)


def test_wav_chunks(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((np.arange(40_000) % 1000).astype("<i2").tobytes())
    got = wav_chunks(spark, str(tmp_path / "a.wav"), 1).select("chunk", "start_s", F.size("samples").alias("n")).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 16000), (1, 1.0, 16000), (2, 2.0, 8000)]
    assert pd.notna(got[0].n)


def test_sentences_within_a_fragment():
    words = [("Hello.", 0.2, 0.6), ("Goodbye.", 1.0, 1.5)]
    out = Assembler().add(A, "Hello. Goodbye.", 5.0, 7.0, 700, words=words)
    assert [(u["text"], u["reason"], u["start_s"], u["end_s"]) for u in out] == [("Hello.", "internal_sentence", 5.0, 5.8), ("Goodbye.", "completion_score", 5.8, 7.0)]
    assert out[1]["words"] == [{"word": "Goodbye.", "start_s": 6.0, "end_s": 6.5}]
    m = Assembler()
    out = m.add(A, "Hello. I want to", 0, 0.7, 0, True, words=[("Hello.", 0.0, 0.2), ("I", 0.3, 0.4), ("want", 0.4, 0.5), ("to", 0.5, 0.6)]) + m.add(B, "Absolutely.", 0.8, 1.4, 700)
    assert [(u["text"], u["interrupted"]) for u in out] == [("Hello.", False), ("I want to", True), ("Absolutely.", False)]


@pytest.mark.parametrize("words", [[("Hello.", 0.2, float("nan")), ("Goodbye.", 1.0, 1.5)], [("Hello.", 0.2, 3.0), ("Goodbye.", 3.0, 3.5)], [("Hello.", 0.0, 0.0), ("Goodbye.", 0.0, 1.0)], [(" ", 0, 0.1), ("think...", 0.2, 0.3), ("so.", 0.4, 0.5)], [("Hi.", 0, 1)]])
def test_words_that_cannot_be_cut(words):
    assert len(assembly.sentences("text", 0.0, 2.0, words)) == 1


def test_progress_rows_close_turns_in_batch_and_stream(spark, tmp_path):
    schema = "session_id long, sequence_id long, speaker_id string, text string, start_s double, end_s double, pause_ms double, is_partial boolean, confidence double, processed_s double, voice_s double"
    rows = [(1, 0, A, "This clause is complete", 0.0, 0.8, 300.0, False, 0.9, None, None), (1, 1, None, None, None, None, None, None, None, 1.5, 0.5), (1, 2, None, "Who said this.", 2.0, 3.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.text, r.reason, r.confidence) for r in assembly.assemble(df).orderBy("utterance").collect()]
    assert got == [("This clause is complete", "timeout", 0.9), ("Who said this.", "flush", 1.0)]
    for k in range(3):
        df.where(F.col("sequence_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("sequence_id = 2").withColumn("sequence_id", F.lit(3)).withColumn("text", F.lit(None).cast("string")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = assemble_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("progressed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    assert [(r.text, r.reason, r.confidence) for r in spark.table("progressed").orderBy("utterance").collect()] == got


def test_second_pass(spark):
    schema = "session_id long, sequence_id long, speaker_id string, text string, start_s double, end_s double, pause_ms double, is_partial boolean, confidence double"
    rows = [(1, 0, A, "I was", 0.0, 1.0, 0.0, True, 0.5), (1, 1, A, "right.", 0.5, 1.5, 900.0, False, 0.5), (2, 0, A, "Broken is this.", 0.0, 1.0, 900.0, False, 0.5), (3, 0, A, "No sound is kept.", 0.0, 1.0, 900.0, False, 0.5)]
    heard = assembly.assemble(spark.createDataFrame(rows, schema))
    sounds = [(1, 0, 0.0, [1.0] * 16000), (1, 1, 0.5, [3.0] * 16000), (2, 0, 0.0, [9.0] * 16000), (3, 0, 0.0, [])]
    audio = spark.createDataFrame(sounds, "session_id long, sequence_id long, start_s double, samples array<float>")
    whole = np.array(assembly.utterance_audio(heard, audio).where("session_id = 1").first().samples)
    assert len(whole) == 4480 + 24000 + 4800
    assert [whole[i] for i in (0, 4480, 4480 + 12000, 4480 + 20000, -1)] == [0.0, 1.0, 2.0, 3.0, 0.0]

    def make():
        def f(a):
            if any(np.max(x) == 9 for x in a):
                raise ValueError
            return pd.DataFrame({"text": [" I was  right" for _ in a], "confidence": 0.8, "avg_logprob": -0.1, "no_speech_prob": 0.0})

        return f

    got = {r.session_id: (r.text, r.second_pass, r.confidence) for r in assembly.second_pass(heard, audio, make).collect()}
    assert got == {1: ("I was right", True, 0.8), 2: ("Broken is this.", False, 0.5), 3: ("No sound is kept.", False, 0.5)}
