"""Simpler mergers of fragments: by pause and grammar, by continuity, or up to an end mark.

What depends on two neighbouring fragments only is worked out as columns; the
fold that remains counts words and closes groups.  A speaker's group ends when
another one speaks, so it always ends in the fragment just before in the
session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.continuity import continuity
from ..functions.text import continues, incomplete_english, strip

OUTPUT = "session_id long, utterance long, speaker_id string, start_s double, end_s double, text string, confidence double, fragments array<string>, merged boolean"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Longest pause within a sentence and within a buffer, seconds without a continuation that close a group, words of the longest group and of one that an end mark closes.
PAUSE, BUFFER_PAUSE, WAIT, MOST_WORDS, LEAST_WORDS = 1.2, 1.8, 0.35, 35, 5
_LINKS = frozenset(rules.CONTINUATIONS)
_DOTS = re.compile(r"[.…]+\s*$")


def as_sentence(parts: list[str]) -> str:
    """Parts without dots between them, links in small letters, and an end mark; a single part stays as it is."""
    if len(parts) == 1:
        return parts[0]
    shown = []
    for k, part in enumerate(parts):
        head, _, tail = part.partition(" ")
        text = f"{head.lower()} {tail}".strip() if k and head.lower() in _LINKS else part
        shown.append(_DOTS.sub("", text) if k < len(parts) - 1 else text)
    whole = " ".join(" ".join(s.split()) for s in shown if s.strip())
    return whole if whole.endswith((".", "!", "?", "…")) or not whole else whole + "."


def spaced(parts: list[str]) -> str:
    """Parts with one space between them; a dash that cuts off goes."""
    out = parts[0]
    for p in parts[1:]:
        out = f"{out.rstrip('-—').strip() if out.endswith(('-', '—')) else out} {p}"
    return out if len(parts) == 1 else " ".join(out.split())


def glued(parts: list[str]) -> str:
    """Parts with a space between them, but none after a dash or before a mark."""
    out = ""
    for p in parts:
        out += p if not out or out.endswith(("-", "—")) or p.startswith((",", ".", "?", "!")) else f" {p}"
    return out.strip()


RULES = {"pause": as_sentence, "continuity": spaced, "buffer": glued}


def _flags(rule: str, text: Column, before: Column, start: Column, speaker: Column, partial: Column) -> tuple[Column, Column, Column]:
    """(joins the one before, closes a group that it joins, stands alone) by ``rule``."""
    marked, gap = text.rlike(r"[.!?]$"), F.greatest(F.lit(0.0), start - before["end_s"])
    linked = incomplete_english(before["text"]) | continues(text)
    if rule == "pause":
        return (gap <= PAUSE) & linked, ~incomplete_english(text) & marked, ~incomplete_english(text)
    if rule == "continuity":
        same = continuity(before["text"], before["speaker_id"], before["end_s"], text, speaker, start)["continuous"]
        return same & linked, marked, marked
    ends = marked | ~F.coalesce(partial, F.lit(False))
    return gap <= BUFFER_PAUSE, ends, ends


@dataclass
class Group:
    rule: str
    rows: list = field(default_factory=list)
    out: list[dict] = field(default_factory=list)

    def close(self) -> None:
        if self.rows:
            texts = [r.text for r in self.rows]
            sure = sum(r.confidence for r in self.rows) / len(self.rows)
            self.out.append(
                {
                    "utterance": len(self.out) + 1, "speaker_id": self.rows[0].speaker_id, "start_s": self.rows[0].start_s, "end_s": self.rows[-1].end_s,
                    "text": RULES[self.rule](texts), "confidence": round(sure, 3) if self.rule == "pause" else sure, "fragments": texts, "merged": len(texts) > 1,
                }
            )
        self.rows = []

    def add(self, r) -> None:
        if not pd.isna(r.processed_s):
            if self.rows and r.processed_s - self.rows[-1].end_s >= (BUFFER_PAUSE if self.rule == "buffer" else WAIT):
                self.close()
            return
        if self.rows and self.rows[-1].speaker_id != r.speaker_id:
            self.close()
        words = sum(len(x.text.split()) for x in self.rows) + len(r.text.split())
        if self.rows and r.joins and (self.rule == "buffer" or words <= MOST_WORDS):
            self.rows.append(r)
            if r.closes and (self.rule != "continuity" or words >= LEAST_WORDS):
                self.close()
            return
        began = not self.rows
        self.close()
        self.rows = [r]
        if r.whole if began and self.rule == "continuity" else r.alone:
            self.close()


def merge(fragments: DataFrame, rule: str = "pause") -> DataFrame:
    """Sentences of (session_id, sequence_id, speaker_id, text, start_s, end_s, confidence) and, if there, is_partial and processed_s.

    ``pause``: a fragment goes on after a short pause if the one before is
    open or it begins like a continuation.  ``continuity``: it must have the
    score of :func:`functions.continuity.continuity` besides.  ``buffer``:
    everything up to an end mark or a fragment that isn't partial.  No group
    is lost when another speaker or a complete sentence follows.  Rows with
    processed_s are no fragments but close a group that has waited long
    enough.  Blank texts count for nothing; a null speaker is one speaker, a
    null confidence 1.  A session is one group and fits one task.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    optional = {"is_partial": "boolean", "processed_s": "double"}
    given = fragments.select("session_id", "sequence_id", F.coalesce("speaker_id", F.lit("unknown")).alias("speaker_id"), strip(F.col("text")).alias("text"), "start_s", "end_s", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *[F.col(c) if c in fragments.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    given = given.where((F.coalesce("text", F.lit("")) != "") | F.col("processed_s").isNotNull())
    order = Window.partitionBy("session_id").orderBy("sequence_id", "start_s")
    speech = F.when(F.col("processed_s").isNull(), F.struct("text", "speaker_id", "end_s"))
    given = given.withColumn("before", F.last(speech, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    joins, closes, alone = _flags(rule, F.col("text"), F.col("before"), F.col("start_s"), F.col("speaker_id"), F.col("is_partial"))
    false = F.lit(False)
    marked = given.select("*", F.coalesce(joins, false).alias("joins"), F.coalesce(closes, false).alias("closes"), F.coalesce(alone, false).alias("alone"), (~incomplete_english(F.col("text"))).alias("whole")).drop("before", "is_partial")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = Group(rule)
        for r in pdf.sort_values(["sequence_id", "start_s"], kind="stable").itertuples():
            group.add(r)
        group.close()
        return pd.DataFrame([{"session_id": key[0], **r} for r in group.out], columns=COLUMNS)

    return marked.groupBy("session_id").applyInPandas(run, OUTPUT)
