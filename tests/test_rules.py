"""Continuity, losses, natural Spanish, preferences."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions.continuity import continuity
from parlance.functions.loss import audio_marks, loss
from parlance.functions.text import natural_spanish, without_artifacts
from parlance.sources import preferences


def test_continuity(spark):
    rows = [
        (0, "The people I really admire", "A", 2.2, "are Michael Pollan.", "A", 2.4),
        (1, "Hello.", "A", 1.0, "You are here.", "A", 1.2),
        (2, "I want to", "A", 1.0, "go home.", "B", 1.2),
        (3, " ", "A", 1.0, "go home.", "A", 1.2),
        (4, "I went", "A", 1.0, "Home.", "A", 4.0),
        (5, "I want to", "A", 1.0, "and go.", "A", 4.0),
        (6, None, None, None, None, None, None),
        (7, "?!", "A", 1.0, "...", "A", 1.0),
    ]
    df = spark.createDataFrame(rows, "k int, a string, sa string, ea double, b string, sb string, sb0 double")
    got = {r.k: r.c for r in df.select("k", continuity(*(F.col(c) for c in ("a", "sa", "ea", "b", "sb", "sb0"))).alias("c")).collect()}
    assert [got[k].reason for k in range(8)] == ["joined", "apart", "other_speaker", "empty", "gap", "joined", "empty", "apart"]
    assert got[0].score == pytest.approx(0.25 + 0.35 * 0.60 + 0.20 * 0.80 + 0.20) and got[2].score == 0.0


def test_losses(spark):
    loud, edge, short, quiet = [0.0] * 240 + [0.1] * 5000, [0.1] * 5000, [0.0] * 240 + [0.1] * 100, [0.001] * 5000
    cases = [
        ([], "a", "a", None, ("audio", "no_samples")), (loud, "text", "", None, ("pipeline", "dropped")), (loud, "a much longer text", "a mu", None, ("pipeline", "cut_short")),
        (None, "", "", "words", ("unknown", "no_audio_kept")), (None, "text", None, None, ("pipeline", "dropped")), (edge, "", "", "words", ("audio", "clipped_or_short")),
        (short, "", "", "words", ("audio", "clipped_or_short")), (loud, None, None, "words", ("recognition", "voice_without_text")), (edge, "you go", "you go", "Will you go", ("audio", "first_word_clipped")),
        (edge, "", "", None, ("audio", "clipped")), (loud, "", "", None, ("recognition", "voice_without_text")), (quiet, "", "", None, ("none", "captured")), (loud, "yes", "yes", "Yes", ("none", "captured")),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, s array<double>, r string, d string, t string")
    got = df.select("k", loss(audio_marks(F.col("s")), F.col("r"), F.col("d"), F.col("t")).alias("l")).orderBy("k").collect()
    assert [(r.l.kind, r.l.reason) for r in got] == [c[4] for c in cases]


def test_natural_spanish(spark):
    rows = [
        ("No fue una fiesta de lástima", "It was no pity party", "No fue dar lástima"), ("Su luz brilla", "It shines through", "Su luz se nota"), ("Su luz brilla", "It is bright", "Su luz brilla"),
        ("Caminando y llevando un diario", "Walking and journaling", "Salir a caminar y escribir en un diario"), ("caminando solo", None, "caminando solo"), ("También brilla", "x", "también se nota"), (None, "x", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, o string, want string")
    assert [r.got for r in df.select(natural_spanish(F.col("t"), F.col("o")).alias("got")).collect()] == [r[2] for r in rows]


def test_artifacts(spark):
    rows = [("- ¿Qué? - Hola", "Hi", "Hola"), ("— Hola", "Hi", "Hola"), ("- Hola", "- Hi", "- Hola"), ("Hola", None, "Hola"), (None, "Hi", None)]
    df = spark.createDataFrame(rows, "t string, o string, want string")
    assert [r.got for r in df.select(without_artifacts(F.col("t"), F.col("o")).alias("got")).collect()] == [r[2] for r in rows]


@pytest.mark.parametrize("name, value", [("target", "fr"), ("font_size", 20.0), ("font_size", True), ("opacity", float("nan")), ("threshold", "0.01"), ("chunk_seconds", 16), ("device_name", 3)])
def test_preferences(tmp_path, name, value):
    path = tmp_path / "deep" / "preferences.json"
    assert preferences.load(path) == (preferences.DEFAULTS, "")
    preferences.save(path, {"font_size": 24})
    path.write_text(json.dumps(json.loads(path.read_text()) | {"unknown": 1}))
    assert preferences.load(path) == (preferences.DEFAULTS | {"font_size": 24}, "")
    with pytest.raises(ValueError):
        preferences.save(path, {name: value})
    path.write_text(json.dumps({name: value}))
    values, message = preferences.load(path)
    assert values == preferences.DEFAULTS and name in message
    path.write_text("{")
    assert preferences.load(path)[1] != ""
