"""Who speaks: voiceprints clustered online, and segments cut where the voice changes.

What needs samples is done first, row by row, before any shuffle: segments are
cut where the voice changes, and each piece gets a voiceprint and a pitch.
Only these go to the state machine of a session, which is the same in batch
and in streams.  Time is the time of the audio.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.audio import RATE, pitch, voiceprint

PIECES = "session_id long, segment long, piece int, start_s double, end_s double, text string, voiceprint array<double>, pitch double, clean boolean, source int"
OUTPUT = "session_id long, segment long, piece int, source int, start_s double, end_s double, text string, speaker_id string, is_new boolean, similarity double, confidence double"
#: Scores at which a voice is taken for a known one: alone, with a lead over the second, for a candidate heard twice, for two sources of one voice.
SURE, NEAR, LEAD, AGAIN, ONE_VOICE = 0.58, 0.48, 0.06, 0.60, 0.80
#: Shares of the centre and of the nearest recent print; bonus of who spoke last, full up to a gap and none from another on.
CENTRE, RECENT, BONUS, FULL_GAP, NO_GAP = 0.70, 0.30, 0.08, 0.20, 0.75
#: Differences of pitch and what they add to a score: below the first, above the third, above the second.
PITCH_ALIKE, PITCH_OFF, PITCH_FAR = (0.12, 0.05), (0.22, -0.15), (0.35, -0.28)
#: Shortest segment in seconds that makes a speaker, shortest clean one that does so at once; prints and pitches kept.
SHORTEST, CLEAN, PRINTS, PITCHES = 0.45, 0.50, 10, 20
#: Cuts: least segment, least pause, least part on both sides; similarity below which voices differ, alone or with a difference of pitch.
LEAST_CUT, PAUSE, PART, DIFFERENT, UNLIKE, UNLIKE_PITCH, OTHER_PITCH = 1.0, 0.15, 0.35, 0.65, 0.85, 0.25, 0.30


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Cosine of unit vectors, kept to 0..1; 0 for different widths."""
    return float(np.clip(np.dot(a, b), 0.0, 1.0)) if a is not None and b is not None and len(a) == len(b) else 0.0


@dataclass
class Profile:
    centre: np.ndarray
    recent: list[np.ndarray]
    pitches: list[float]
    heard: int = 1

    def raw(self, x: np.ndarray) -> float:
        return CENTRE * alike(x, self.centre) + RECENT * max(alike(x, r) for r in self.recent)

    def for_pitch(self, f: float) -> float:
        if f <= 0 or not self.pitches:
            return 0.0
        usual = float(np.median(self.pitches))
        off = abs(f - usual) / usual
        return PITCH_ALIKE[1] if off < PITCH_ALIKE[0] else PITCH_FAR[1] if off > PITCH_FAR[0] else PITCH_OFF[1] if off > PITCH_OFF[0] else 0.0

    def learn(self, x: np.ndarray, f: float) -> None:
        """Moves the centre by at most a fifth and keeps the latest prints and pitches."""
        w = min(0.20, 1 / (self.heard + 1))
        moved = (1 - w) * self.centre + w * x
        size = float(np.linalg.norm(moved))
        self.centre = moved / size if size > 1e-6 else self.centre
        self.heard += 1
        self.recent = [*self.recent, x][-PRINTS:]
        if f > 0:
            self.pitches = [*self.pitches, f][-PITCHES:]


@dataclass
class Tracker:
    """One session's speakers, numbered in the order in which they are first heard."""

    known: dict[str, Profile] = field(default_factory=dict)
    last: str | None = None
    made: int = 0
    waiting: np.ndarray | None = None
    until: float | None = None

    def state(self) -> str:
        """All that is known, as JSON that names its fields; see :meth:`of`."""
        return json.dumps(asdict(self), default=lambda x: x.tolist())

    @classmethod
    def of(cls, state: str) -> Tracker:
        read = json.loads(state)
        vector = lambda v: None if v is None else np.array(v)
        known = {k: Profile(vector(p["centre"]), [vector(x) for x in p["recent"]], p["pitches"], p["heard"]) for k, p in read.pop("known").items()}
        return cls(known=known, waiting=vector(read.pop("waiting")), **read)

    def _name(self) -> str:
        self.made += 1
        return f"SPEAKER_{self.made:02d}"

    def _meet(self, x: np.ndarray | None, f: float = 0.0) -> str:
        name = self._name()
        if x is not None:
            self.known[name] = Profile(x, [x], [f] if f > 0 else [])
        return name

    def _usual(self) -> str:
        return self.last if self.last in self.known else next(iter(self.known))

    def _bonus(self, start: float) -> float:
        gap = max(0.0, start - self.until) if self.until is not None else 0.0
        return BONUS * float(np.clip((NO_GAP - gap) / (NO_GAP - FULL_GAP), 0.0, 1.0))

    def hear(self, x: np.ndarray | None, f: float, start: float, end: float, clean: bool = True) -> tuple[str, float, bool]:
        """(speaker, similarity, new) of a segment of one voice; one without a print is the last speaker's."""
        before = self.made
        if x is None:
            return (self._usual() if self.known else self._name()), 0.0, self.made > before
        seconds = end - start
        if not self.known:
            self.last = self._meet(x, f)
            score = 1.0
        else:
            self.last, score = self._decide(x, f, seconds, clean, self._bonus(start))
        self.until = max(end, self.until or end)
        return self.last, score, self.made > before

    def _decide(self, x: np.ndarray, f: float, seconds: float, clean: bool, bonus: float) -> tuple[str, float]:
        raw = {name: p.raw(x) for name, p in self.known.items()}
        total = {name: min(1.0, max(0.0, raw[name] + p.for_pitch(f))) + bonus * (name == self.last) for name, p in self.known.items()}
        best = max(total, key=total.get)
        score = total[best]
        ranked = sorted(raw, key=raw.get, reverse=True)
        if len(ranked) > 1 and self.last and ranked[0] != self.last and raw[ranked[0]] >= SURE:
            best, score = ranked[0], raw[ranked[0]]
        if score >= SURE:
            if clean and seconds >= CLEAN:
                self.known[best].learn(x, f)
            return best, score
        if len(ranked) > 1 and raw[ranked[0]] >= NEAR and raw[ranked[0]] - raw[ranked[1]] >= LEAD:
            return ranked[0], raw[ranked[0]]
        if seconds < SHORTEST:
            return (best if raw[best] >= NEAR else self._usual()), raw[best]
        if self.waiting is None and clean and seconds >= CLEAN or self.waiting is not None and alike(x, self.waiting) >= AGAIN:
            self.waiting = None
            return self._meet(x, f), 1.0
        self.waiting = x
        return self._usual(), raw[self._usual()]

    def apart(self, speaker: str, x: np.ndarray | None, f: float) -> str:
        """Another speaker than ``speaker``: the first known one, or a new one."""
        others = [name for name in self.known if name != speaker]
        self.last = others[0] if others else self._meet(x, f)
        return self.last

    def pair(self, x: np.ndarray | None, y: np.ndarray | None) -> list[tuple[str, float, float, bool]]:
        """(speaker, similarity, confidence, new) of two voices at once.

        Nearly equal prints are one speaker.  With two speakers known, the
        order that fits better holds, the given one on a tie; only the first
        two known are compared.  A voice without a print counts as half alike.
        """
        fit = lambda v, name: 0.5 if v is None else alike(v, self.known[name].centre)
        if x is not None and y is not None and alike(x, y) >= ONE_VOICE:
            new = not self.known
            name = self._meet(x) if new else self._usual()
            return [(name, alike(x, y), 0.95, new)] * 2
        if not self.known:
            first, second = self._meet(x), self._meet(y)
            self.last = first
            return [(first, 1.0, 1.0, True), (second, 1.0, 1.0, True)]
        a, *rest = self.known
        if not rest:
            as_first, as_second = fit(x, a), fit(y, a)
            if as_first >= as_second:
                return [(a, as_first, 0.90, False), (self._meet(y), as_second, 0.85, True)]
            return [(self._meet(x), as_first, 0.85, True), (a, as_second, 0.90, False)]
        b = rest[0]
        swap = fit(x, b) + fit(y, a) > fit(x, a) + fit(y, b)
        first, second = (b, a) if swap else (a, b)
        self.last = first
        return [(first, fit(x, first), 0.90, False), (second, fit(y, second), 0.90, False)]


def _differ(a: np.ndarray, b: np.ndarray) -> bool:
    x, y, f, g = voiceprint(a), voiceprint(b), pitch(a), pitch(b)
    if x is None or y is None:
        return False
    off = abs(f - g) / max(1.0, f) if f > 0 and g > 0 else 0.0
    return alike(x, y) < DIFFERENT or alike(x, y) < UNLIKE and off > UNLIKE_PITCH or off > OTHER_PITCH


def cut_points(audio: np.ndarray, words: list[tuple[str, float, float]]) -> list[int]:
    """Indices of words after which the voice changes.

    A stretch is cut at its longest pause between words, the first of equal
    ones, if both sides are long enough and differ; then both sides are looked
    at in the same way.  Stretches are kept on a list, not by recursion, so
    the number of cuts has no limit.
    """
    found: list[int] = []
    todo = [(0, len(words), 0, len(audio))]
    while todo:
        lo, hi, begin, stop = todo.pop()
        if hi - lo < 2 or (stop - begin) / RATE < LEAST_CUT:
            continue
        first, end = begin / RATE, stop / RATE
        fit = [(words[i + 1][1] - words[i][2], -i) for i in range(lo, hi - 1) if words[i][2] - first >= PART and end - words[i + 1][1] >= PART]
        pause, at = max(fit, default=(0.0, 0))
        if pause < PAUSE:
            continue
        middle = int(words[-at][2] * RATE)
        if min(middle - begin, stop - middle) < int(PART * RATE) or not _differ(audio[begin:middle], audio[middle:stop]):
            continue
        found.append(-at)
        todo += [(lo, 1 - at, begin, middle), (1 - at, hi, middle, stop)]
    return sorted(found)


def pieces(segments: DataFrame) -> DataFrame:
    """Segments (session_id, segment, start_s, end_s, text, samples, words, clean, source) as pieces of one voice each.

    ``words`` are (word, start, end) from the segment's start, or null;
    ``source`` numbers the voices of a separated segment from 0 and is null
    for others.  A segment that is cut gives its words' texts, else its own.
    Samples at 16 kHz are read here and leave no trace but a print and a pitch;
    null or empty ones give no print.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                audio = np.asarray(r.samples if r.samples is not None else [], np.float32)
                words = [(w["word"] or "", float(w["start"] or 0.0), float(w["end"] or 0.0)) for w in (r.words if r.words is not None else [])]
                source = None if pd.isna(r.source) else int(r.source)
                cuts = cut_points(audio, words) if source is None else []
                bounds = [0, *(i + 1 for i in cuts), len(words)]
                times = [0, *(int(words[i][2] * RATE) for i in cuts), len(audio)]
                for k in range(len(cuts) + 1):
                    part = audio[times[k] : times[k + 1]]
                    spoken = " ".join(w.strip() for w, _, _ in words[bounds[k] : bounds[k + 1]]).strip() if cuts else r.text
                    x = voiceprint(part)
                    start = r.start_s + times[k] / RATE
                    end = r.end_s if k == len(cuts) else r.start_s + times[k + 1] / RATE
                    rows.append((r.session_id, r.segment, k, start, end, spoken, None if x is None else x.tolist(), pitch(part), not pd.isna(r.clean) and bool(r.clean), source))
            yield pd.DataFrame(rows, columns=columns).astype({"source": "Int32"})

    return segments.select("session_id", "segment", "start_s", "end_s", "text", "samples", "words", "clean", "source").mapInPandas(run, PIECES)


def follow(machine: Tracker, pdf: pd.DataFrame) -> list[dict]:
    """Pieces in order with their speakers; neighbours of a cut segment never have the same one."""
    out: list[dict] = []
    ordered = pdf.sort_values(["segment", "piece", "source"], kind="stable", na_position="first")
    vector = lambda v: None if v is None or np.ndim(v) == 0 or not len(v) else np.asarray(v, float)
    for _, group in ordered.groupby("segment", sort=False):
        rows = list(group.itertuples())
        separated = [r for r in rows if not pd.isna(r.source)]
        if len(separated) == 2:
            answers = machine.pair(*[vector(r.voiceprint) for r in separated])
            machine.until = max([r.end_s for r in separated] + ([machine.until] if machine.until is not None else []))
            out += [_row(r, *a) for r, a in zip(separated, answers, strict=True)]
            rows = [r for r in rows if pd.isna(r.source)]
        before = None
        for r in rows:
            x, f = vector(r.voiceprint), 0.0 if pd.isna(r.pitch) else r.pitch
            made = machine.made
            speaker, score, _ = machine.hear(x, f, r.start_s, r.end_s, bool(r.clean) and pd.isna(r.source))
            if before == speaker and r.piece > 0:
                speaker = machine.apart(before, x, f)
            out.append(_row(r, speaker, score, 0.90 if len(rows) > 1 else 1.0, machine.made > made))
            before = speaker
    return out


def _row(r, speaker: str, score: float, confidence: float, new: bool) -> dict:
    return {
        "segment": r.segment, "piece": r.piece, "source": None if pd.isna(r.source) else int(r.source), "start_s": r.start_s, "end_s": r.end_s, "text": r.text,
        "speaker_id": speaker, "is_new": new, "similarity": score, "confidence": confidence,
    }


def answer(session: int, rows: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame([{"session_id": session, **r} for r in rows], columns=columns).astype({"source": "Int32"})


def track(cut: DataFrame) -> DataFrame:
    """Speakers of the rows of :func:`pieces`; a session is one group of small rows, without samples."""
    return cut.groupBy("session_id").applyInPandas(lambda key, pdf: answer(key[0], follow(Tracker(), pdf)), OUTPUT)
