"""Voice activity: speech segments of a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import energy
from ..functions.audio import RATE, Resampler

OUTPUT = "session_id long, segment int, start_s double, end_s double, samples int, reason string, trailing_ms int, processed_s double, voice_s double"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Pauses in ms that close a segment, by profile.
PROFILES = {"fast": 350, "balanced": 550, "natural": 800}


@dataclass
class Detector:
    """Frames at or above ``threshold`` are voice; a pause of ``silence_ms`` closes a segment.

    Frames are told by their samples and level only.  The last ``preroll``
    frames before a voice belong to it.  A segment under ``least_ms``, with all
    that belongs to it, is dropped.  At ``most_s`` it is cut after its quietest
    frame of the last 1.5 s, or of its second half if that is shorter, the
    first of equally quiet ones, and goes on with the rest.  Frames without
    samples change nothing.
    """

    threshold: float = 0.015
    silence_ms: float = 550
    least_ms: float = 180
    most_s: float = 12.0
    preroll: int = 10
    rate: int = RATE
    ring: list[tuple[int, float]] = field(default_factory=list)
    frames: list[tuple[int, float]] = field(default_factory=list)
    speaking: bool = False
    silent: int = 0
    processed: int = 0
    voiced: int = 0
    count: int = 0

    def _held(self) -> int:
        return sum(n for n, _ in self.frames)

    def _segment(self, n: int, reason: str, trailing: int = 0) -> list[dict]:
        self.count += 1
        end = self.processed - (self._held() if reason == "max_duration" else 0)
        return [{"segment": self.count - 1, "start_s": max(0, end - n) / self.rate, "end_s": end / self.rate, "samples": n, "reason": reason, "trailing_ms": trailing}]

    def _close(self, reason: str, trailing: int = 0) -> list[dict]:
        n = self._held()
        out = self._segment(n, reason, trailing) if self.frames and n / self.rate * 1000 >= self.least_ms else []
        self.frames, self.ring, self.silent, self.speaking = [], [], 0, False
        return out

    def _cut(self) -> list[dict]:
        total = len(self.frames)
        window = min(int(1.5 * self.rate / self.frames[0][0]), max(2, total // 2))
        if total < 4 or window < 2:
            return self._close("max_duration")
        tail = range(total - window, total)
        cut = min(tail, key=lambda i: self.frames[i][1]) + 1
        n = sum(k for k, _ in self.frames[:cut])
        self.frames, self.silent = self.frames[cut:], 0
        return self._segment(n, "max_duration")

    def add(self, n: int, level: float) -> list[dict]:
        """Segments that a frame of ``n`` samples completes."""
        if not n:
            return []
        voice = level >= self.threshold
        self.processed += n
        if voice:
            self.voiced = self.processed
        if not self.speaking:
            if voice:
                self.frames, self.ring, self.silent, self.speaking = [*self.ring, (n, level)], [], 0, True
            elif self.preroll:
                self.ring = [*self.ring, (n, level)][-self.preroll :]
            return []
        self.frames.append((n, level))
        self.silent = 0 if voice else self.silent + n
        pause = self.silent / self.rate * 1000
        if pause >= self.silence_ms:
            return self._close("silence", int(pause))
        return self._cut() if self._held() / self.rate >= self.most_s else []

    def flush(self) -> list[dict]:
        return self._close("shutdown") if self.speaking else []

    def progress(self) -> dict:
        """Up to where audio was heard, and where the last voice ended, in seconds of audio: what the assembler's timeouts go by."""
        return {"reason": "progress", "processed_s": self.processed / self.rate, "voice_s": self.voiced / self.rate}


def levels(frames: DataFrame, *more: str) -> DataFrame:
    """(session_id, frame_seq, n, level): frames without their samples, all that the detector needs."""
    n = F.greatest(F.size("samples"), F.lit(0))
    return frames.select("session_id", "frame_seq", F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(energy(F.col("samples").cast("array<double>")), F.lit(0.0)).alias("level"), *more)


def options_of(profile: str | None = None, **options) -> dict:
    """Options of :class:`Detector`; a profile's name stands for its pause."""
    return ({"silence_ms": PROFILES[profile]} if profile else {}) | options


def detect(frames: DataFrame, profile: str | None = None, progress: bool = False, **options) -> DataFrame:
    """Speech segments of (session_id, frame_seq, samples) rows, by session in the order of frames.

    With ``progress`` each session has a row at the end, with the reason
    progress, that tells how far it was heard.  Levels are worked out before
    the shuffle, so a session's group has two numbers for each frame.
    """
    chosen = options_of(profile, **options)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, rows = Detector(**chosen), []
        for r in pdf.sort_values("frame_seq", kind="stable").itertuples():
            rows += d.add(r.n, r.level)
        rows += d.flush()
        rows += [d.progress()] if progress else []
        return answer(key[0], rows)

    return levels(frames).groupBy("session_id").applyInPandas(run, OUTPUT)


def answer(session: int, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"session_id": session, **r} for r in rows], columns=COLUMNS).astype({"segment": "Int32", "samples": "Int32", "trailing_ms": "Int32"})


def resampled(frames: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """(session_id, frame_seq, samples) at 16 kHz: a session's frames in order, the rest of one carried into the next; the last rest is left out.

    Sessions stream through their task in order, so none has to fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, machine = None, Resampler(rate, channels)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.session_id != session:
                    session, machine = r.session_id, Resampler(rate, channels)
                rows.append((r.session_id, r.frame_seq, machine.add(r.samples if r.samples is not None else []).tolist()))
            yield pd.DataFrame(rows, columns=["session_id", "frame_seq", "samples"])

    ordered = frames.select("session_id", "frame_seq", "samples").repartition("session_id").sortWithinPartitions("session_id", "frame_seq")
    return ordered.mapInPandas(run, "session_id long, frame_seq long, samples array<float>")


def _silence(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), n).cast("int"))


def padded(segments: DataFrame, frames: DataFrame, before_s: float = 0.3, after_s: float = 0.3, frame_s: float = 0.03) -> DataFrame:
    """Segments (session_id, segment, start_s, samples) with padded: their samples after the audio that came before, and before silence.

    ``frames`` are (session_id, t_s, samples), each from ``t_s`` on and at
    most ``frame_s`` long.  What was not heard is silence, so every result has
    the same length around the segment; a segment without samples has none.
    Frames and segments meet by equal time slots, never as a product.
    """
    slot = before_s + frame_s
    n = int(before_s * RATE)
    own = segments.select("session_id", "segment", F.col("start_s").alias("at_s"), F.explode(F.sequence(F.floor((F.col("start_s") - slot) / slot), F.floor(F.col("start_s") / slot))).alias("slot"))
    heard = frames.select("session_id", "t_s", F.col("samples").cast("array<float>").alias("f"), F.floor(F.col("t_s") / slot).alias("slot"))
    near = own.join(heard, ["session_id", "slot"]).where((F.col("t_s") < F.col("at_s")) & (F.col("t_s") >= F.col("at_s") - slot))
    room = F.bround((F.col("at_s") - F.col("t_s")) * RATE).cast("int")
    history = near.groupBy("session_id", "segment").agg(F.sort_array(F.collect_list(F.struct("t_s", F.slice("f", F.lit(1), room).alias("f")))).alias("h"))
    tail = F.flatten(F.transform("h", lambda x: x["f"]))
    cut = F.when(F.size(tail) > n, F.slice(tail, F.size(tail) - n + 1, F.lit(n))).otherwise(tail)
    before = history.select("session_id", "segment", cut.alias("_before"))
    joined = segments.join(before, ["session_id", "segment"], "left")
    own_before = F.coalesce("_before", F.array().cast("array<float>"))
    whole = F.concat(_silence(n - F.size(own_before)), own_before, F.col("samples").cast("array<float>"), _silence(F.lit(int(after_s * RATE))))
    return joined.withColumn("padded", F.when(F.size("samples") > 0, whole).otherwise(F.array().cast("array<float>"))).drop("_before")
