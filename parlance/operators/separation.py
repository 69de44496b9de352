"""Two voices at once: separation, and whether what comes out are two voices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import RATE, peaks, voiceprint
from .tracking import alike

Separator = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
SCORES = "samples0 int, samples1 int, level0 double, level1 double, correlation double, spectrum double, voice double"
SEPARATED = "first array<float>, second array<float>, scores struct<" + SCORES.replace(" ", ": ").replace(",:", ",") + ">"
#: Transform and its step; fundamentals looked for, their least distance, what stands in for none; harmonics, half width and floor of their comb.
SIZE, STEP, LOWEST, HIGHEST, APART, USUAL, HARMONICS, WIDTH, FLOOR = 512, 128, 80, 400, 25, (130.0, 230.0), 11, 15, 0.15
#: Limits of the check: samples, level, share of the weaker, correlation, spectrum with voice, voice alone.
SAMPLES, LEVEL, SHARE, SAME_WAVE, SAME_SPECTRUM, WITH_VOICE, SAME_VOICE = 512, 0.005, 0.08, 0.60, 0.86, 0.68, 0.72


def _transform(x: np.ndarray, step: int) -> np.ndarray:
    """Spectra of windowed frames, (frames, bins); the signal is padded so that every sample is covered."""
    room = np.concatenate([np.zeros(SIZE), np.asarray(x, np.float64), np.zeros(2 * SIZE)])
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(room, SIZE)[::step] * np.hanning(SIZE + 1)[:-1])


def _back(spectra: np.ndarray, step: int, n: int) -> np.ndarray:
    """The signal of spectra: frames are added up, divided by the sum of squared windows."""
    window = np.hanning(SIZE + 1)[:-1]
    frames = np.fft.irfft(spectra, SIZE) * window
    out, weight = np.zeros(step * (len(frames) - 1) + SIZE), np.zeros(step * (len(frames) - 1) + SIZE)
    for i, frame in enumerate(frames):
        out[i * step : i * step + SIZE] += frame
        weight[i * step : i * step + SIZE] += window**2
    return (out / np.maximum(weight, 1e-8))[SIZE : SIZE + n].astype(np.float32)


def by_harmonics(audio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two voices by the combs of the two strongest fundamentals: soft masks that add up to one, with the phase of the whole.

    Under 512 samples both are empty.  The two results add up to the input.
    """
    if len(audio) < SAMPLES:
        return np.zeros(0, np.float32), np.zeros(0, np.float32)
    spectra = _transform(audio, STEP)
    lo, hi = LOWEST * SIZE // RATE, HIGHEST * SIZE // RATE
    mean = np.abs(spectra)[:, lo:hi].mean(axis=0)
    at = peaks(mean, -np.inf, max(1, APART * SIZE // RATE))[:2]
    fundamentals = [(lo + i) * RATE / SIZE for i in at] if len(at) == 2 else list(USUAL)
    half = max(1, WIDTH * SIZE // RATE)
    combs = np.full((2, SIZE // 2 + 1), FLOOR)
    for comb, f in zip(combs, fundamentals, strict=True):
        for k in range(1, HARMONICS + 1):
            if k * f < RATE / 2:
                i = round(k * f * SIZE / RATE)
                comb[max(0, i - half) : i + half + 1] += 1.0
    power = (np.abs(spectra)[None] * combs[:, None]) ** 2
    mask = power[0] / (power[0] + power[1] + 1e-6)
    first = _back(spectra * mask, STEP, len(audio))
    return first, (np.asarray(audio, np.float32) - first).astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray) -> tuple:
    """What the check needs: lengths, levels, correlation of the waves, likeness of the mean spectra and of the voices (0.5 without prints)."""
    level = lambda x: float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    if min(len(a), len(b)) < SAMPLES:
        return len(a), len(b), level(a), level(b), None, None, None
    n = min(len(a), len(b))
    x, y = (np.asarray(v[:n], np.float64) for v in (a, b))
    cosine = lambda p, q: float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q) + 1e-7))
    means = [np.abs(_transform(v, SIZE // 2)).mean(axis=0) for v in (x, y)]
    prints = voiceprint(a), voiceprint(b)
    voice = 0.5 if prints[0] is None or prints[1] is None else alike(*prints)
    return len(a), len(b), level(a), level(b), float(np.clip(cosine(x - x.mean(), y - y.mean()), -1, 1)), cosine(*means), voice


def verdict(s: Column) -> Column:
    """The first check that two separated voices fail: short, quiet, leak, same_wave, same_voice; else two_voices."""
    weaker = F.least(s["level0"], s["level1"]) / (F.greatest(s["level0"], s["level1"]) + 1e-7)
    return (
        F.when(s.isNull() | (F.least(s["samples0"], s["samples1"]) < SAMPLES), "short")
        .when(F.greatest(s["level0"], s["level1"]) < LEVEL, "quiet")
        .when(weaker < SHARE, "leak")
        .when(s["correlation"] >= SAME_WAVE, "same_wave")
        .when((s["spectrum"] >= SAME_SPECTRUM) & (s["voice"] >= WITH_VOICE), "same_voice")
        .when(s["voice"] >= SAME_VOICE, "same_voice")
        .otherwise("two_voices")
    )


def separate(segments: DataFrame, make: Callable[[], Separator] = lambda: by_harmonics, overlap: str = "is_overlap") -> DataFrame:
    """Segments (samples, is_overlap, ...) with source and verdict: a row for each voice of those that hold two, the others as they are.

    Rows without overlap, or null in it, pass by and never reach the
    separator.  Where it fails, or its voices don't pass the check, the
    original stays; verdict says why (failed for an error) and is null for
    rows that passed by.
    """
    over = F.coalesce(F.col(overlap), F.lit(False))

    @F.pandas_udf(SEPARATED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for batch in batches:
            rows = []
            for samples in batch:
                audio = np.asarray(samples if samples is not None else [], np.float32)
                try:
                    a, b = f(audio)
                except Exception:  # a segment that fails keeps its audio and costs no other
                    rows.append((None, None, None))
                    continue
                rows.append((np.asarray(a, np.float32).tolist(), np.asarray(b, np.float32).tolist(), dict(zip([c.split()[0] for c in SCORES.split(", ")], scores(a, b), strict=True))))
            first, second, marks = zip(*rows, strict=True) if rows else ((), (), ())
            names = [c.split()[0] for c in SCORES.split(", ")]
            yield pd.DataFrame({"first": list(first), "second": list(second), "scores": [m if m is not None else dict.fromkeys(names) for m in marks]})

    apart = segments.where(over).withColumn("_s", run(F.col("samples")))
    apart = apart.withColumn("verdict", F.when(F.col("_s.first").isNull(), "failed").otherwise(verdict(F.col("_s.scores"))))
    two = F.array(F.struct(F.lit(0).alias("source"), F.col("_s.first").alias("samples")), F.struct(F.lit(1).alias("source"), F.col("_s.second").alias("samples")))
    one = F.array(F.struct(F.lit(None).cast("int").alias("source"), F.col("samples").cast("array<float>").alias("samples")))
    sources = F.explode(F.when(F.col("verdict") == "two_voices", two).otherwise(one))
    others = [c for c in segments.columns if c not in ("samples", "source", "verdict")]
    split = apart.select(*others, "verdict", sources.alias("_v")).select(*others, F.col("_v.samples").alias("samples"), F.col("_v.source").alias("source"), "verdict")
    rest = segments.where(~over).select(*others, F.col("samples").cast("array<float>").alias("samples"), F.lit(None).cast("int").alias("source"), F.lit(None).cast("string").alias("verdict"))
    return rest.unionByName(split)
