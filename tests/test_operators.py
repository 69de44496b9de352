"""Duplicates, evaluation, providers, subtitles and audio kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.functions import text as T
from parlance.operators import duplicates, evaluate, providers

TURNS = "session_id long, speaker_id string, text string, start_s double, end_s double"


def test_english_rules(spark):
    cases = [("I want to", True, False), ("Because it", True, True), ("This is fine.", False, False), ("for everyone.", False, True), ("and then we left.", False, True), ("i think so.", True, False), ("Yes", False, False), ("", False, False), ("one two three", True, True)]
    df = spark.createDataFrame(cases, "t string, a boolean, b boolean").select("*", T.incomplete_english(F.col("t")).alias("x"), T.continues(F.col("t")).alias("y"))
    for r in df.collect():
        assert (r.x, r.y) == (r.a, r.b), r


def test_subtitles_break_once(spark):
    texts = ["Corta.", "Esta es una frase bastante larga que no cabe en una sola línea de texto", "hola hola mundo", None, "x" * 60, "uno, dos tres cuatro cinco seis siete ocho nueve diez once doce"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.subtitle(F.col("t")).alias("o")).orderBy("i").collect()
    out = [r.o for r in rows]
    assert out[0] == "Corta." and out[2] == "hola mundo" and out[3] == "" and out[4] == "x" * 60
    for i in (1, 5):
        a, b = out[i].split("\n")
        assert f"{a} {b}" == texts[i] and max(len(a), len(b)) <= 42
    assert out[1].split("\n")[1].startswith("que no cabe")


def test_similarity():
    assert duplicates.similarity("Are you ready?", "Are you ready") == 1.0
    assert duplicates.similarity("I love working on myself", "I love to work on myself") == pytest.approx(0.7687, abs=1e-4)
    assert duplicates.similarity("I think we should leave right now.", "No, wait! Stay here.") == pytest.approx(0.208, abs=1e-3)
    assert duplicates.similarity("", "x") == 0.0


def test_repeats_and_channels(spark):
    rows = [(1, "A", "Are you ready?", 0.0, 1.0), (1, "A", "Are you ready", 0.05, 1.1), (1, "A", "Are you ready", 5.0, 6.0), (1, "B", "Are you ready?", 0.0, 1.0), (2, "A", None, 0.0, 1.0)]
    got = duplicates.suppress_repeats(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.session_id, r.speaker_id, r.start_s) for r in got) == [(1, "A", 0.0), (1, "A", 5.0), (1, "B", 0.0), (2, "A", 0.0)]
    pairs = [(1, 1, "A", "the idea of physicalism m", 0.0, 2.0, 0.9), (1, 1, "B", "the idea of physicalism means that all is physical", 0.1, 3.0, 0.8), (1, 2, "A", "Leave right now please", 0.0, 1.0, 0.9), (1, 2, "B", "No, wait! Stay here.", 0.0, 1.0, 0.9)]
    df = spark.createDataFrame(pairs, "session_id long, sequence_id long, speaker_id string, text string, start_s double, end_s double, confidence double")
    assert sorted((r.sequence_id, r.speaker_id) for r in duplicates.resolve_channels(df).collect()) == [(1, "B"), (2, "A"), (2, "B")]


def test_evaluation(spark):
    truth = [(1, "A", "we should go home now", 0.0, 2.0), (1, "B", "yes of course we will", 2.5, 4.5)]
    good = evaluate.rates(evaluate.evaluate(spark.createDataFrame(truth, TURNS), spark.createDataFrame(truth, TURNS))).first()
    assert good.mean_coverage == 100 and good.sentence_completeness == 100 and good.cross_speaker_merge_rate == 0 and good.missed_utterance_rate == 0
    merged = [(1, "A", "we should go home now yes of course we will", 0.0, 4.5)]
    bad = evaluate.rates(evaluate.evaluate(spark.createDataFrame(truth, TURNS), spark.createDataFrame(merged, TURNS))).first()
    assert bad.cross_speaker_merge_rate == 100 and bad.missed_utterance_rate == 50
    assert evaluate.common_length("a b c d".split(), "b x d".split()) == 2 and evaluate.common_length([], ["a"]) == 0
    alone = evaluate.evaluate(spark.createDataFrame(truth, TURNS), spark.createDataFrame([], TURNS)).first()
    assert alone.missed == 2 and alone.coverage == 0


def test_translation_routes(spark):
    rows = [(1, "hello world", "en", True, False), (2, "hello", "en", False, False), (3, "hola", "es", True, False), (4, "bom dia", "pt", True, False), (5, "boom", "en", True, False)]
    df = spark.createDataFrame(rows, "id int, text string, language string, is_complete boolean, is_interrupted boolean")

    def fragile():
        def f(texts: pd.Series) -> pd.Series:
            if texts.str.contains("boom").any():
                raise ValueError("failed")
            return texts.str.replace("hello", "hola")

        return f

    got = {r.id: r.translated for r in providers.translate(df, {("en", "es"): fragile}, providers.dictionary({"bom": "buen", "boom": "bum"})).collect()}
    assert got == {1: "hola world", 2: "hello", 3: "hola", 4: "buen dia", 5: "bum"}
    assert {r.id: r.translated for r in providers.translate(df, {}).collect()}[4] == "bom dia"
    assert providers.local_only("http://localhost:1/x") and not providers.local_only("http://localhost.evil/") and not providers.local_only("https://127.0.0.1")


def test_retry(spark):
    rows = [(1, "fine text", 0.9, -0.2, 0.1, [0.1]), (2, "poor", 0.3, -0.2, 0.1, [0.5]), (3, "poor", 0.3, -0.2, 0.1, [0.0])]
    df = spark.createDataFrame(rows, "id int, text string, confidence double, avg_logprob double, no_speech_prob double, audio array<double>")

    def make():
        return lambda a: pd.DataFrame({"text": ["again" if x[0] > 0 else "" for x in a], "confidence": 0.8, "avg_logprob": -0.1, "no_speech_prob": 0.0}, index=a.index)

    got = {r.id: (r.text, r.why, r.recovered) for r in providers.retry(df, make).collect()}
    assert got == {1: ("fine text", "ok", False), 2: ("again", "confidence", True), 3: ("poor", "confidence", False)}


def tone(parts, seconds=1.0):
    t = np.arange(int(16000 * seconds)) / 16000
    return sum(a * np.sin(2 * np.pi * f * t) for f, a in parts).astype(np.float32)


def test_audio_kernels(spark):
    a, b = tone([(130, 0.5), (260, 0.25)]), tone([(240, 0.5), (480, 0.25)])
    assert audio.pitch(a) == pytest.approx(130, rel=0.03) and audio.pitch(b) == pytest.approx(240, rel=0.03) and audio.pitch(np.zeros(16000)) == 0
    p, q = audio.voiceprint(a), audio.voiceprint(b)
    assert len(p) == 64 and np.linalg.norm(p) == pytest.approx(1) and p @ audio.voiceprint(0.9 * a) > 0.9 > p @ q and audio.voiceprint(np.zeros(16000)) is None
    assert not audio.overlap(tone([(140, 0.5), (280, 0.25), (420, 0.15)]))[0]
    assert audio.overlap(tone([(125, 0.4), (250, 0.2), (220, 0.4), (440, 0.2)]))[0]
    assert len(audio.resample(np.ones(480), 48000)) == 160 and abs(len(audio.resample(tone([(440, 0.5)], 0.1), 44100)) - 1600 * 16000 / 44100) < 5
    slow = audio.resample(np.sin(2 * np.pi * 440 * np.arange(44100) / 44100), 44100)
    assert np.abs(slow[100:-100] - np.sin(2 * np.pi * 440 * np.arange(len(slow)) / 16000)[100:-100]).max() < 0.01
    df = spark.createDataFrame([(a.tolist(),), (None,)], "s array<float>").select(audio.pitch_of("s").alias("p"), audio.overlap_of("s").alias("o"), audio.voiceprint_of("s").alias("v"))
    got = df.collect()
    assert got[0].p == pytest.approx(130, rel=0.03) and got[1].p == 0 and got[1].v is None and not got[1].o.has_overlap


def test_display_and_answers(spark):
    from parlance.operators import context

    rows = [(1, 1, "A", "Hola", 0.0), (1, 2, "A", "Hola a todos", 1.0), (1, 3, "B", "Sí", 2.0), (1, 4, "A", None, 3.0), (1, 5, "A", "Bien", 4.0), (1, 6, "B", "Claro", 30.0)]
    df = spark.createDataFrame(rows, "session_id long, id long, speaker_id string, original string, start_s double")
    got = {r.id: r.shown for r in context.shown_turns(df).collect()}
    assert got == {1: ["Hola"], 2: ["Hola a todos"], 3: ["Hola a todos", "Sí"], 4: ["Hola a todos", "Sí"], 5: ["Sí", "Bien"], 6: ["Claro"]}
    said = spark.createDataFrame([("Exactly.", True), ("for sure", True), ("sure", False), ("other", True)], "t string, o boolean")
    assert [r.x for r in said.select(T.brief_answer(F.col("t"), F.col("o")).alias("x")).collect()] == ["Exacto.", "Por supuesto.", None, None]


def test_scorecard(spark):
    from parlance.operators.evaluate import scorecard

    schema = "session_id long, speaker_id string, text string, start_s double, end_s double"
    true = [("A", "This is a whole sentence.", 0.0, 2.0), ("B", "Yes.", 2.5, 3.0)]
    rows = lambda k, turns: [(k, *t) for t in turns]
    truth = spark.createDataFrame(rows(1, true) + rows(2, true) + rows(3, true) + rows(4, true[:1]), schema)
    merged = [("A", "This is a whole sentence. Yes.", 0.0, 3.0)]
    outputs = spark.createDataFrame(rows(1, true) + rows(2, [("A", "This is", 0.0, 2.0), ("B", "", 2.5, 3.0)]) + rows(3, merged) + rows(4, [("A", "This is a whole sentence.", 0.0, 2.0), ("B", None, 2.0, 2.2)]), schema)
    got = {r.session_id: r for r in scorecard(truth, outputs).collect()}
    first = got[1].asDict()
    good = {"short_utterance_recall", "speaker_turn_precision", "speaker_turn_recall", "sentence_completeness", "source_dialogue_coverage"}
    assert {k for k, v in first.items() if v == 100.0} == good and all(v == 0.0 for k, v in first.items() if k not in good | {"session_id"})
    assert got[2].sentence_completeness == 0.0 and got[2].wer == pytest.approx(66.67) and got[2].missed_utterance_rate == 50.0
    assert got[3].cross_speaker_merge_rate == 100.0 and got[3].speaker_turn_recall == 0.0 and got[3].speaker_turn_precision == 0.0
    assert got[4].speaker_turn_precision == 0.0 and got[4].speaker_turn_recall == 100.0
