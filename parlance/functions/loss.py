"""Where dialogue got lost: in the audio, in recognition, or after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import energy
from .text import strip

#: Level of speech, samples of the shortest speech, level at an edge that means a cut, samples of an edge.
VOICE, SHORTEST, CUT, EDGE = 0.015, 2880, 0.06, 240
#: A delivered text below this share of a recognized text longer than this many characters is cut short.
SHARE, LONG = 0.4, 8


def audio_marks(samples: Column) -> Column:
    """struct(samples, level, onset): what :func:`loss` needs of the audio; null for null samples."""
    onset = F.slice(samples, 1, EDGE)
    return F.when(samples.isNotNull(), F.struct(F.size(samples).alias("samples"), energy(samples).alias("level"), energy(onset).alias("onset")))


def loss(marks: Column, recognized: Column, delivered: Column, truth: Column | None = None) -> Column:
    """struct(kind, confidence, reason): none, audio, recognition, pipeline, or unknown where the audio isn't known.

    ``marks`` is of :func:`audio_marks`.  Null marks mean that nobody kept
    the audio, so that only a loss after recognition can be told; audio of no
    samples is a loss of audio.  Null texts are empty; without a truth the
    level of the audio decides alone.
    """
    raw, final = strip(F.coalesce(recognized, F.lit(""))), strip(F.coalesce(delivered, F.lit("")))
    true = F.lower(strip(F.coalesce(truth, F.lit("")))) if truth is not None else F.lit("")
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    said, heard = words(true), words(F.lower(raw))
    cut, short, loud = marks["onset"] > CUT, marks["samples"] < SHORTEST, marks["level"] > VOICE
    silent, first_lost = raw == "", (F.size(heard) > 0) & (F.size(said) > F.size(heard)) & (F.get(said, F.lit(0)) != F.get(heard, F.lit(0)))
    kinds = (
        (F.coalesce(marks["samples"] == 0, F.lit(False)), "audio", 1.0, "no_samples"),
        (~silent & (final == ""), "pipeline", 1.0, "dropped"),
        ((F.length(final) < SHARE * F.length(raw)) & (F.length(raw) > LONG), "pipeline", 0.85, "cut_short"),
        (marks.isNull(), "unknown", 0.0, "no_audio_kept"),
        ((true != "") & silent & (cut | short), "audio", 0.90, "clipped_or_short"),
        ((true != "") & silent & loud, "recognition", 0.90, "voice_without_text"),
        ((true != "") & first_lost & cut, "audio", 0.85, "first_word_clipped"),
        (silent & loud & ~short & cut, "audio", 0.80, "clipped"),
        (silent & loud & ~short, "recognition", 0.80, "voice_without_text"),
    )
    result = None
    for when, kind, sure, reason in kinds:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))
        result = F.when(when, value) if result is None else result.when(when, value)
    return result.otherwise(F.struct(F.lit("none").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("captured").alias("reason")))
