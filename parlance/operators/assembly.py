"""Sentence and turn assembly: a state machine for each session, the same in batch and in streams.

Fragments of a speaker are joined until the text, the pause or another speaker
ends the utterance.  A session is the key, since another speaker's fragment
closes the one before.  Rows of a session are taken by sequence and start.

Rows are (session_id, sequence_id, speaker_id, text, start_s, end_s, pause_ms,
is_partial, confidence), and may have words (word, start and end from the
fragment's start), asr_s (seconds that recognition took), captured_s (when the
fragment's end was captured), is_overlap, and processed_s and voice_s: a row
with the latter is no fragment but tells up to where audio was heard and where
the last voice ended.  A null speaker is one speaker; a null pause is 0, a null
confidence 1.  An utterance has the sum of asr_s, the latest captured_s, and
whether any fragment overlaps another voice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .providers import Recognizer, recognized

OUTPUT = "session_id long, utterance long, speaker_id string, start_s double, end_s double, text string, reason string, score double, fragments int, interrupted boolean, complete boolean, confidence double, parts array<struct<sequence_id: long, start_s: double, end_s: double>>, words array<struct<word: string, start_s: double, end_s: double>>, asr_s double, captured_s double, is_overlap boolean"
COLUMNS = ["session_id", "utterance", "speaker_id", "start_s", "end_s", "text", "reason", "score", "fragments", "interrupted", "complete", "confidence", "parts", "words", "asr_s", "captured_s", "is_overlap"]
_FINITE = re.compile(rf"\b(?:{'|'.join(rules.FINITE_VERBS)})\b", re.I)
_OPEN = [re.compile(p, re.I) for p in rules.OPEN_ENDS]
_LAST = frozenset(rules.CONNECTORS) | frozenset(rules.AUXILIARIES)


def incomplete(text: str) -> bool:
    """The rule of :func:`functions.text.likely_incomplete` for one text."""
    clean = " ".join((text or "").split())
    if not clean or re.search(r"(?:\.\.\.|[…—,:;-])$", clean):
        return True
    if clean[-1] in ".?!":
        return False
    words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clean.lower())
    return any(p.search(clean) for p in _OPEN) or not words or words[-1] in _LAST or len(words) >= 2 and not _FINITE.search(clean)


def score(text: str, pause_ms: float, changed: bool, seconds: float) -> float:
    a, b, c = rules.SHORT_PAUSE, rules.SENTENCE_PAUSE, rules.TURN_PAUSE
    pause = 0.0 if pause_ms < a else 0.25 + 0.35 * (pause_ms - a) / (b - a) if pause_ms < b else 0.8 + 0.2 * (pause_ms - b) / (c - b) if pause_ms < c else 1.0
    punct = 0.0 if re.search(r"(?:[,:;…]|\.\.\.)$", text) else 1.0 if text[-1:] in (".", "?", "!") else 0.25
    w = rules.WEIGHTS
    return round(w["pause"] * pause + w["punct"] * punct + w["syntax"] * (0.0 if incomplete(text) else 0.85) + w["speaker"] * changed + w["duration"] * min(1.0, seconds / rules.LONGEST_TURN), 4)


def join(parts: list[str]) -> str:
    out = ""
    for p in parts:
        if out.endswith(("-", "—")):
            out = out[:-1].rstrip() + p
        else:
            out = f"{out} {p}" if out else p
    return re.sub(r"\s+([,.?!;:])", r"\1", out)


def sentences(text: str, start: float, end: float, words: list[tuple[str, float, float]]) -> list[tuple[str, float, float, list[tuple[str, float, float]]]]:
    """A fragment as (text, start, end, words) for each sentence that its words hold; cut in the middle between two words.

    Words' times are from the fragment's start, in the results from the
    session's.  If a cut is no time within the fragment after the one before,
    or a part has no text, the fragment stays whole.
    """
    shift = lambda some: [(w, max(0.0, start + a), max(0.0, start + b)) for w, a, b in some]
    whole = [(text, start, end, shift(words))]
    ends = [i for i, (w, _, _) in enumerate(words[:-1]) if w.rstrip().endswith((".", "?", "!")) and not w.rstrip().endswith("...")]
    cuts = [(words[i][2] + words[i + 1][1]) / 2 for i in ends]
    if not ends or not all(a < b for a, b in zip([0.0, *cuts], [*cuts, end - start], strict=True)):
        return whole
    bounds, times = [0, *(i + 1 for i in ends), len(words)], [start, *(start + c for c in cuts), end]
    parts = [(" ".join(w.strip() for w, _, _ in words[i:j]).strip(), a, b, shift(words[i:j])) for i, j, a, b in zip(bounds, bounds[1:], times, times[1:], strict=False)]
    return parts if all(p[0] for p in parts) else whole


@dataclass
class Turn:
    start: float
    end: float
    parts: list[str] = field(default_factory=list)
    confidence: list[float] = field(default_factory=list)
    pause: float = 0.0
    partial: bool = False
    pieces: list[dict] = field(default_factory=list)
    words: list[dict] = field(default_factory=list)
    asr: float = 0.0
    captured: float | None = None
    overlap: bool = False


class Assembler:
    """One session's state: a turn for each speaker, and who spoke last."""

    def __init__(self) -> None:
        self.turns: dict[str, Turn] = {}
        self.last: str | None = None
        self.count = 0

    def state(self) -> str:
        """All that is open, as JSON that names its fields; see :meth:`of`."""
        return json.dumps({"turns": {k: asdict(t) for k, t in self.turns.items()}, "last": self.last, "count": self.count}, default=lambda x: x.item())

    @classmethod
    def of(cls, state: str) -> Assembler:
        read, new = json.loads(state), cls()
        new.turns, new.last, new.count = {k: Turn(**t) for k, t in read["turns"].items()}, read["last"], read["count"]
        return new

    def _close(self, speaker: str, reason: str, interrupted: bool = False, changed: bool = False) -> list[dict]:
        turn = self.turns.pop(speaker, None)
        if turn is None:
            return []
        text = join(turn.parts)
        self.count += 1
        return [
            {
                "utterance": self.count, "speaker_id": speaker, "start_s": turn.start, "end_s": turn.end, "text": text, "reason": reason,
                "score": score(text, turn.pause, changed, turn.end - turn.start), "fragments": len(turn.parts), "interrupted": interrupted,
                "complete": not interrupted and not incomplete(text), "confidence": sum(turn.confidence) / len(turn.confidence),
                "parts": turn.pieces, "words": turn.words, "asr_s": turn.asr, "captured_s": turn.captured, "is_overlap": turn.overlap,
            }
        ]

    def add(self, speaker: str, text: str, start: float, end: float, pause_ms: float = 0, partial: bool = False, confidence: float = 1.0, words: list[tuple[str, float, float]] | None = None, sequence: int = 0, asr_s: float = 0.0, captured_s: float | None = None, overlap: bool = False) -> list[dict]:
        """Utterances that a fragment completes."""
        text = " ".join((text or "").split())
        if not text:
            return []
        out: list[dict] = []
        if self.last not in (None, speaker) and self.last in self.turns:
            out += self._close(self.last, "speaker_change", incomplete(join(self.turns[self.last].parts)), True)
        self.last = speaker
        turn = self.turns.get(speaker)
        if turn and not turn.partial and not incomplete(join(turn.parts)):
            pause = turn.pause + max(0.0, start - turn.end) * 1000
            total = score(join(turn.parts), pause, False, turn.end - turn.start)
            if pause >= rules.TURN_PAUSE or pause >= rules.SENTENCE_PAUSE and total >= rules.COMPLETE:
                out += self._close(speaker, "acoustic_gap")
        parts = sentences(text, start, end, words or [])
        for k, (piece, begin, until, spoken) in enumerate(parts):
            last = k == len(parts) - 1
            turn = self.turns.setdefault(speaker, Turn(begin, until))
            # A fragment's time of recognition counts once, with its first piece
            turn.asr, turn.overlap = turn.asr + (asr_s if not k else 0.0), turn.overlap or overlap
            turn.captured = captured_s if turn.captured is None else max(turn.captured, turn.captured if captured_s is None else captured_s)
            out += self._append(speaker, piece, begin, until, pause_ms if last else rules.SENTENCE_PAUSE, partial and last, confidence, spoken, sequence, last)
        return out

    def _append(self, speaker: str, text: str, start: float, end: float, pause_ms: float, partial: bool, confidence: float, words: list[tuple[str, float, float]], sequence: int, last: bool) -> list[dict]:
        turn = self.turns[speaker]
        turn.parts.append(text)
        turn.confidence.append(confidence)
        turn.pieces.append({"sequence_id": sequence, "start_s": start, "end_s": end})
        turn.words += [{"word": w, "start_s": a, "end_s": b} for w, a, b in words]
        turn.end, turn.pause, turn.partial = max(turn.end, end), pause_ms, partial
        if not last:
            return self._close(speaker, "internal_sentence")
        whole = join(turn.parts)
        if not partial and not incomplete(whole) and score(whole, pause_ms, False, turn.end - turn.start) >= rules.COMPLETE:
            return self._close(speaker, "completion_score")
        return self._close(speaker, "max_turn") if turn.end - turn.start >= rules.LONGEST_TURN else []

    def progress(self, processed: float, voice: float) -> list[dict]:
        """Utterances that silence completes: audio is heard up to ``processed``, the last voice ended at ``voice``."""
        out: list[dict] = []
        for speaker, turn in list(self.turns.items()):
            text = join(turn.parts)
            if processed < turn.end or voice > turn.end + 0.001 or turn.partial or incomplete(text):
                continue
            pause = turn.pause + (processed - turn.end) * 1000
            if pause >= rules.TURN_PAUSE or pause >= rules.SENTENCE_PAUSE and score(text, pause, False, turn.end - turn.start) >= rules.COMPLETE:
                out += self._close(speaker, "timeout")
        return out

    def flush(self) -> list[dict]:
        out: list[dict] = []
        for speaker in list(self.turns):
            out += self._close(speaker, "flush", incomplete(join(self.turns[speaker].parts)))
        return out


def feed(machine: Assembler, pdf: pd.DataFrame) -> list[dict]:
    """Fragments and progress in order of sequence and start; rows with neither text nor progress change nothing."""
    out: list[dict] = []
    given = lambda v, other: other if pd.isna(v) else v
    for r in pdf.sort_values(["sequence_id", "start_s"], kind="stable").itertuples():
        heard, words = getattr(r, "processed_s", None), getattr(r, "words", None)
        if not pd.isna(heard):
            out += machine.progress(heard, given(r.voice_s, 0.0))
        elif isinstance(r.text, str):
            spoken = [(w["word"] or "", given(w["start"], float("nan")), given(w["end"], float("nan"))) for w in (words if words is not None else [])]
            out += machine.add(given(r.speaker_id, "unknown"), r.text, r.start_s, r.end_s, given(r.pause_ms, 0.0), bool(given(r.is_partial, False)), given(r.confidence, 1.0), spoken, r.sequence_id, given(getattr(r, "asr_s", None), 0.0), given(getattr(r, "captured_s", None), None), bool(given(getattr(r, "is_overlap", None), False)))
    return out


def assemble(fragments: DataFrame) -> DataFrame:
    """Utterances of each session's fragments; open turns are closed at the end.  A session is one group, so it fits one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine = Assembler()
        rows = feed(machine, pdf) + machine.flush()
        return pd.DataFrame([{"session_id": key[0], **r} for r in rows], columns=COLUMNS)

    return fragments.groupBy("session_id").applyInPandas(run, OUTPUT)


def utterance_audio(utterances: DataFrame, audio: DataFrame, rate: int = 16000, before_ms: int = 280, after_ms: int = 300) -> DataFrame:
    """(session_id, utterance, samples): the audio of an utterance's parts on one time line, the mean where parts overlap, with silence around.

    ``audio`` is (session_id, sequence_id, start_s, samples), a row for each
    fragment.  Only utterances of which some audio is there have a row.
    """
    parts = utterances.select("session_id", "utterance", F.explode("parts").alias("p")).select("session_id", "utterance", "p.*")
    sounds = audio.where(F.size("samples") > 0).select("session_id", "sequence_id", F.col("start_s").alias("at_s"), "samples")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = pdf["start_s"].min(), pdf["end_s"].max()
        total = np.zeros(max(1, round((end - start) * rate)))
        times = np.zeros(len(total))
        for r in pdf.itertuples():
            cut = np.asarray(r.samples, np.float64)[max(0, round((r.start_s - r.at_s) * rate)) : max(0, round((r.end_s - r.at_s) * rate))]
            at = round((r.start_s - start) * rate)
            cut = cut[: len(total) - at]
            total[at : at + len(cut)] += cut
            times[at : at + len(cut)] += 1
        mean = np.divide(total, times, out=total, where=times > 0)
        silence = np.zeros(before_ms * rate // 1000), np.zeros(after_ms * rate // 1000)
        return pd.DataFrame([(key[0], key[1], np.concatenate([silence[0], mean, silence[1]]).astype(np.float32).tolist())], columns=["session_id", "utterance", "samples"])

    return parts.join(sounds, ["session_id", "sequence_id"]).groupBy("session_id", "utterance").applyInPandas(run, "session_id long, utterance long, samples array<float>")


def second_pass(utterances: DataFrame, audio: DataFrame, make: Callable[[], Recognizer], **options) -> DataFrame:
    """Utterances recognized again as a whole, with second_pass: whether the new text counts.

    Audio goes past the state machine: each utterance's samples are gathered
    after it, and the recognizer is made once for a task.  Where it fails,
    finds no text, or has no audio, the assembled text stays; ``complete``
    goes by the text that is kept.
    """
    again = recognized(make)
    new = utterance_audio(utterances, audio, **options).withColumn("_n", again(F.col("samples"))).select("session_id", "utterance", T.collapse(F.col("_n.text")).alias("_text"), F.col("_n.confidence").alias("_sure"))
    both = utterances.join(new, ["session_id", "utterance"], "left").withColumn("second_pass", F.coalesce(F.col("_text") != "", F.lit(False)))
    both = both.withColumn("text", F.when(F.col("second_pass"), F.col("_text")).otherwise(F.col("text")))
    both = both.withColumn("confidence", F.when(F.col("second_pass"), F.coalesce("_sure", "confidence")).otherwise(F.col("confidence")))
    return both.withColumn("complete", ~F.col("interrupted") & ~T.likely_incomplete(F.col("text"))).select(*utterances.columns, "second_pass")
