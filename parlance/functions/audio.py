"""Kernels on 16 kHz mono samples: pitch, two voices at once, voiceprints, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16000
#: Mel bands, transform and step of voiceprints; cepstral coefficients and bands that a print has.
BANDS, SIZE, STEP, COEFFICIENTS, LOW_BANDS = 48, 512, 256, 24, 14


def pitch(audio: np.ndarray) -> float:
    """Fundamental frequency from 70 to 400 Hz: the median over the five loudest 100 ms frames by autocorrelation; 0 for none."""
    n, hop = RATE // 10, RATE // 20
    if len(audio) < n:
        return 0.0
    frames = np.lib.stride_tricks.sliding_window_view(audio.astype(np.float64), n)[::hop]
    level = np.sqrt((frames**2).mean(axis=1))
    found = []
    for i in np.argsort(-level, kind="stable")[:5]:
        x = frames[i] - frames[i].mean()
        power = (x**2).sum()
        if level[i] < 0.02 or power < 1e-6:
            continue
        spectrum = np.abs(np.fft.rfft(x, 4096)) ** 2
        lags = np.fft.irfft(spectrum)[RATE // 400 : RATE // 70]
        if lags.max() > 0.25 * power:
            found.append(RATE / (RATE // 400 + int(lags.argmax())))
    return float(np.median(found)) if found else 0.0


def peaks(x: np.ndarray, least: float, apart: int) -> np.ndarray:
    """Local maxima of a least height, the higher first, none closer than ``apart`` to a higher one."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= least)) + 1
    kept: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(i - k) >= apart for k in kept):
            kept.append(int(i))
    return np.array(kept, int)


def two_voices(frame: np.ndarray) -> float:
    """How likely a 50 ms frame has two fundamentals from 75 to 450 Hz of which one isn't the other's harmonic."""
    n = 2048
    size = np.abs(np.fft.rfft(frame, n))
    if size.max() <= 1e-6:
        return 0.0
    lo, hi = n * 75 // RATE, n * 450 // RATE
    at = peaks(size[lo:hi], 0.2 * size.max(), n * 25 // RATE)[:2]
    if len(at) < 2:
        return 0.1 * len(at)
    f, m = (at + lo) * RATE / n, size[at + lo]
    ratio = f.max() / f.min()
    if round(ratio) >= 2 and abs(ratio - round(ratio)) <= 0.09:
        return 0.15
    share = m.min() / m.max()
    return float(min(0.98, 0.5 + 0.45 * share) if share >= 0.35 else 0.2 + 0.3 * share)


def overlap(audio: np.ndarray, least: float = 0.60, seconds: float = 0.2) -> tuple[bool, float]:
    """Whether two people speak at once for ``seconds``, and how sure that is: over frames of 50 ms every 25 ms."""
    n, hop = RATE // 20, RATE // 40
    if len(audio) < n:
        return False, 0.0
    sure = np.array([two_voices(audio[i : i + n]) for i in range(0, len(audio) - n + 1, hop)])
    at = np.flatnonzero(sure >= 0.9 * least)
    if len(at) >= max(2, int(seconds * RATE / hop)) and sure[at].mean() >= least:
        return True, round(float(sure[at].mean()), 3)
    return False, round(float(sure.max()), 3)


def _mel_filters() -> np.ndarray:
    mel = np.linspace(2595 * np.log10(1 + 80 / 700), 2595 * np.log10(1 + RATE / 2 / 700), BANDS + 2)
    edge = np.floor((SIZE + 1) * 700 * (10 ** (mel / 2595) - 1) / RATE)
    j = np.arange(SIZE // 2 + 1)[None, :]
    a, b, c = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    up, down = (j - a) / np.maximum(b - a, 1), (c - j) / np.maximum(c - b, 1)
    return np.where((j >= a) & (j < b), up, np.where((j >= b) & (j < c), down, 0.0))


def voiceprint(audio: np.ndarray) -> np.ndarray | None:
    """64 numbers of length 1: means and deviations of cepstral coefficients, the spectral centre, low bands; None for silence."""
    if len(audio) < SIZE or np.sqrt(np.mean(np.square(audio, dtype=np.float64))) < 0.01:
        return None
    x = np.concatenate([np.zeros(STEP), audio.astype(np.float64), np.zeros(SIZE)])
    frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[::STEP] * np.hanning(SIZE + 1)[:-1]
    power = (np.abs(np.fft.rfft(frames)) * 2 / SIZE) ** 2
    bands = np.log1p(power @ _mel_filters().T)
    k = np.arange(BANDS)
    basis = np.sqrt(2 / BANDS) * np.cos(np.pi / BANDS * (k[:, None] + 0.5) * np.arange(1, COEFFICIENTS + 1)[None, :])
    cepstrum = bands @ basis
    centre = (power * np.linspace(0, 1, SIZE // 2 + 1)).sum(axis=1) / (power.sum(axis=1) + 1e-7)
    mean = bands.mean(axis=0)
    out = np.concatenate([cepstrum.mean(axis=0), cepstrum.std(axis=0), [0.1 * centre.mean(), 0.1 * centre.std()], (mean - mean.mean())[:LOW_BANDS]])
    norm = np.linalg.norm(out)
    return out / norm if norm >= 1e-6 else None


def resample(audio: np.ndarray, rate: int) -> np.ndarray:
    """To 16 kHz: means of blocks for whole factors, else a windowed-sinc interpolation."""
    if rate == RATE or not len(audio):
        return np.asarray(audio, np.float32)
    if rate % RATE == 0:
        k = rate // RATE
        return np.asarray(audio[: len(audio) // k * k], np.float64).reshape(-1, k).mean(axis=1).astype(np.float32)
    n = int(len(audio) * RATE / rate)
    at, cut = np.arange(n) * rate / RATE, min(1.0, RATE / rate)
    near = np.floor(at).astype(int)[:, None] + np.arange(-15, 17)[None, :]
    d = at[:, None] - near
    weight = cut * np.sinc(cut * d) * np.where(np.abs(d) < 16, 0.5 + 0.5 * np.cos(np.pi * d / 16), 0)
    return (weight * np.asarray(audio, np.float64)[np.clip(near, 0, len(audio) - 1)]).sum(axis=1).astype(np.float32)


class Resampler:
    """Blocks to 16 kHz one after another: what doesn't fill a whole step waits for the next block.

    For whole factors the result is that of the blocks put together.  Blocks
    of several channels, interleaved, become their mean.
    """

    def __init__(self, rate: int, channels: int = 1) -> None:
        self.rate, self.channels = rate, channels
        self.step = rate // math.gcd(rate, RATE)
        self.rest = np.zeros(0, np.float32)

    def add(self, block: np.ndarray) -> np.ndarray:
        mono = np.asarray(block, np.float32)
        if self.channels > 1:
            mono = mono[: len(mono) // self.channels * self.channels].reshape(-1, self.channels).mean(axis=1)
        whole = np.concatenate([self.rest, mono])
        n = len(whole) // self.step * self.step
        self.rest = whole[n:]
        return resample(whole[:n], self.rate)


@F.pandas_udf(T.DoubleType())
def pitch_of(samples: pd.Series) -> pd.Series:
    return samples.map(lambda a: pitch(np.asarray(a, np.float32)) if a is not None else 0.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def voiceprint_of(samples: pd.Series) -> pd.Series:
    prints = [None if a is None else voiceprint(np.asarray(a, np.float32)) for a in samples]
    return pd.Series([None if p is None else p.tolist() for p in prints])


@F.pandas_udf(T.StructType([T.StructField("has_overlap", T.BooleanType()), T.StructField("confidence", T.DoubleType())]))
def overlap_of(samples: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([overlap(np.asarray(a if a is not None else [], np.float32)) for a in samples], columns=["has_overlap", "confidence"])
