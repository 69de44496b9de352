"""Whether a fragment goes on from the one before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import strip, tokens

#: Weights of time, grammar, closing and speaker; least total and grammar; full and largest gap in seconds; grammar that bridges a larger one.
WEIGHTS, LEAST, LEAST_GRAMMAR, FULL_GAP, LARGEST_GAP, BRIDGE = (0.25, 0.35, 0.20, 0.20), 0.50, 0.25, 0.30, 1.40, 0.85


def _starts_small(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}") & ~c.startswith("i ")


def grammar(a: Column, b: Column) -> Column:
    """0 to 1: how strongly the end of ``a`` and the start of ``b`` belong together; 0 if either has no word."""
    x, y = tokens(a), tokens(b)
    last, first = F.element_at(x, -1), F.get(y, F.lit(0))
    signs = (
        (last.isin(rules.LINKS), 0.45),
        (last.isin(rules.ENGLISH_AUXILIARIES), 0.40),
        (last.isin(rules.TRANSITIVE), 0.35),
        (first.isin(rules.LINKS), 0.25),
        (_starts_small(b), 0.25),
        (a.rlike(r"(?:\.\.\.|…|-)$"), 0.35),
    )
    total = F.lit(0.0)
    for sign, weight in signs:
        total = total + F.when(sign, weight).otherwise(0.0)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.least(F.lit(1.0), total)).otherwise(0.0)


def closing(a: Column, b: Column) -> Column:
    """How open the end of ``a`` is: after an end mark little, unless ``b`` begins small."""
    return F.when(~a.rlike(r"[.!?]$"), 0.80).when(_starts_small(b), 0.40).otherwise(0.15)


def nearness(gap: Column) -> Column:
    """1 up to the full gap, 0 from the largest, and a line between."""
    line = 1.0 - (gap - FULL_GAP) / (LARGEST_GAP - FULL_GAP)
    return F.when(gap <= FULL_GAP, 1.0).when(gap >= LARGEST_GAP, 0.0).otherwise(line)


def continuity(text_a: Column, speaker_a: Column, end_a: Column, text_b: Column, speaker_b: Column, start_b: Column) -> Column:
    """struct(score, continuous, reason): whether two fragments belong to one sentence.

    Different speakers never do, nor does a text without characters; a null
    speaker is a speaker of its own.  Reasons: other_speaker, empty, gap,
    joined, apart.
    """
    a, b = strip(F.coalesce(text_a, F.lit(""))), strip(F.coalesce(text_b, F.lit("")))
    gap = F.greatest(F.lit(0.0), start_b - end_a)
    g = grammar(a, b)
    w = WEIGHTS
    total = w[0] * nearness(gap) + w[1] * g + w[2] * closing(a, b) + w[3]
    other = ~speaker_a.eqNullSafe(speaker_b)
    far = (gap >= LARGEST_GAP) & (g < BRIDGE)
    joined = (total >= LEAST) & (g >= LEAST_GRAMMAR)
    reason = F.when(other, "other_speaker").when((a == "") | (b == ""), "empty").when(far, "gap").when(joined, "joined").otherwise("apart")
    score = F.when(reason.isin("other_speaker", "empty"), 0.0).otherwise(total)
    return F.struct(score.alias("score"), (reason == "joined").alias("continuous"), reason.alias("reason"))
