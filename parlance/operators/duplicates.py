"""Transcripts of one utterance heard twice: similarity, suppression, the better of two."""

from __future__ import annotations

import difflib
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as St

#: Similarity and seconds of the two rules; weights of characters and words.
SUPPRESS, SAME_START, KEEP_S = 0.75, 0.15, 2.5
ALIKE, NEAR_START = 0.70, 1.2
CHARACTERS, WORDS = 0.65, 0.35


def normal(text: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").lower()).split())


def similarity(a: str | None, b: str | None) -> float:
    """0 to 1: equal texts 1, one within the other at half its length 0.9, else matching characters and words."""
    return _similarity(normal(a), normal(b), 0.0)


def alike(a: str | None, b: str | None, least: float) -> bool:
    """Whether the similarity is at least ``least``; characters are only matched as far as they can decide it."""
    return _similarity(normal(a), normal(b), least) >= least


def _similarity(a: str, b: str, least: float) -> float:
    """The similarity of normal texts, or a bound of it that is below ``least``."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if short in long and 2 * len(short) >= len(long):
        return 0.9
    x, y = set(a.split()), set(b.split())
    words = WORDS * len(x & y) / len(x | y)
    matcher = difflib.SequenceMatcher(None, a, b)
    for ratio in (matcher.real_quick_ratio, matcher.quick_ratio, matcher.ratio):
        score = CHARACTERS * ratio() + words
        if score < least:
            break
    return score


def same_utterance(a, b) -> bool:
    """Whether two rows (text, start_s, end_s) are one utterance: close in time, and alike in their beginning, words or text."""
    if abs(a.start_s - b.start_s) > NEAR_START and not (a.start_s < b.end_s and b.start_s < a.end_s):
        return False
    x, y = normal(a.text).split(), normal(b.text).split()
    shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    if shared >= 3 and shared >= 0.35 * min(len(x), len(y)):
        return True
    least = min(len(set(x)), len(set(y)))
    if least >= 3 and len(set(x) & set(y)) >= 0.65 * least:
        return True
    return alike(a.text, b.text, ALIKE)


def worth(row) -> float:
    """Words, less three for each said twice in a row, plus the confidence (none is 0), less 2.5 for a cut-off last letter."""
    w = (row.text or "").split()
    again = sum(p.lower() == q.lower() for p, q in zip(w, w[1:], strict=False))
    cut = bool(w) and len(w[-1]) == 1 and w[-1].lower() not in "aiyoeu"
    return len(w) - 3 * again + (0.0 if pd.isna(row.confidence) else row.confidence) - 2.5 * cut


def _whole(df: DataFrame, keys: list[str], choose) -> DataFrame:
    schema: St.StructType = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[choose(pdf)]

    return df.groupBy(*keys).applyInPandas(run, schema)


class Heard(NamedTuple):
    """A kept row, as far as later ones are compared with it."""

    text: str | None
    start_s: float
    end_s: float


def novel(pdf: pd.DataFrame, kept: list[Heard]) -> tuple[list, list[Heard]]:
    """(indices of rows that don't repeat a kept one, what is kept for later rows), by start and end."""
    out: list = []
    for r in pdf.sort_values(["start_s", "end_s"], kind="stable").itertuples():
        kept = [k for k in kept if r.start_s - k.end_s < KEEP_S]
        near = [k for k in kept if min(k.end_s, r.end_s) > max(k.start_s, r.start_s) or abs(k.start_s - r.start_s) <= SAME_START]
        if not any(alike(r.text, k.text, SUPPRESS) for k in near):
            out.append(r.Index)
            kept = [*kept, Heard(r.text, float(r.start_s), float(r.end_s))]
    return out, kept


def suppress_repeats(utterances: DataFrame) -> DataFrame:
    """Rows (session_id, speaker_id, text, start_s, end_s) that don't repeat a kept one of the speaker within KEEP_S seconds."""
    return _whole(utterances, ["session_id", "speaker_id"], lambda pdf: novel(pdf, [])[0])


def resolve_channels(transcripts: DataFrame) -> DataFrame:
    """Of the rows of one (session_id, sequence_id) that are one utterance, the best; ties go to the first by start."""

    def choose(pdf: pd.DataFrame) -> list:
        left = list(pdf.sort_values(["start_s", "speaker_id"], kind="stable").itertuples())
        out = []
        while left:
            best, rest = left[0], []
            for other in left[1:]:
                if same_utterance(best, other):
                    best = other if worth(other) > worth(best) else best
                else:
                    rest.append(other)
            out.append(best.Index)
            left = rest
        return out

    return _whole(transcripts, ["session_id", "sequence_id"], choose)
