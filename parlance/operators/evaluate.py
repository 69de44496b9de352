"""A system's turns against the true ones: matching, coverage, completeness, merged speakers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .intervals import within_tolerance
from .metrics import character_error_rate, diarization_errors, with_word_error_rate

OUTPUT = "session_id long, turns long, missed long, short long, short_found long, complete long, coverage double, outputs long, merged long"


def words(text: str | None) -> list[str]:
    return re.findall(r"\b\w+(?:'\w+)?\b", (text or "").lower())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one integer, a bit for each word of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for w in b:
        if match := open_ & places.get(w, 0):
            open_ = (open_ + match | open_ - match) & full
    return len(a) - open_.bit_count()


def complete(reference: str, output: str) -> bool:
    """Nine tenths of the words in order, the first before the last."""
    r, h = words(reference), words(output)
    if not r or not h or common_length(r, h) < 0.9 * len(r) or r[0] not in h or r[-1] not in h:
        return False
    return h.index(r[0]) <= len(h) - 1 - h[::-1].index(r[-1])


def match_turns(truth: pd.DataFrame, outputs: pd.DataFrame) -> list[int | None]:
    """For each true turn, in order, the free output that overlaps most, the first of equals; None without overlap."""
    free = np.ones(len(outputs), bool)
    start, end = outputs["start_s"].to_numpy(float), outputs["end_s"].to_numpy(float)
    out: list[int | None] = []
    for t in truth.itertuples():
        shared = np.where(free, np.minimum(end, t.end_s) - np.maximum(start, t.start_s), 0.0)
        best = int(shared.argmax()) if len(shared) else -1
        if best >= 0 and shared[best] > 0:
            free[best] = False
            out.append(best)
        else:
            out.append(None)
    return out


def evaluate(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """Counts for each session of (session_id, speaker_id, text, start_s, end_s) rows on both sides; see :func:`rates`."""
    columns = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(key: tuple, t: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        t, o = (x.sort_values(["start_s", "end_s"], kind="stable").reset_index(drop=True) for x in (t, o))
        found = match_turns(t, o)
        texts = [None if k is None else o["text"][k] for k in found]
        short = [len((x or "").split()) <= 3 or e - s <= 1.2 for x, s, e in zip(t["text"], t["start_s"], t["end_s"], strict=True)]
        whole = [complete(x or "", y) if y else False for x, y in zip(t["text"], texts, strict=True)]
        reference, said = words(" ".join(t["text"].fillna(""))), words(" ".join(o["text"].fillna("")))
        merged = 0
        said_by = [words(x) for x in t["text"]]
        starts, ends, who = t["start_s"].to_numpy(float), t["end_s"].to_numpy(float), t["speaker_id"].tolist()
        for start, end, text in zip(o["start_s"], o["end_s"], o["text"], strict=True):
            w = words(text)
            near = np.flatnonzero((starts < end) & (ends > start)) if w else ()
            merged += len({who[k] for k in near if common_length(said_by[k], w) >= (1 if len(said_by[k]) <= 3 else 2)}) > 1
        heard = [bool(y and y.strip()) for y in texts]
        row = (key[0], len(t), heard.count(False), sum(short), sum(a and b for a, b in zip(short, heard, strict=True)), sum(whole), common_length(reference, said) / max(1, len(reference)), int(sum(bool((x or "").strip()) for x in o["text"])), merged)
        return pd.DataFrame([row], columns=columns)

    return truth.groupBy("session_id").cogroup(outputs.groupBy("session_id")).applyInPandas(run, OUTPUT)


def rates(counts: DataFrame) -> DataFrame:
    """One row of percentages over all sessions of :func:`evaluate`."""
    part = lambda a, b, empty: F.round(F.when(F.sum(b) > 0, 100 * F.sum(a) / F.sum(b)).otherwise(empty), 2)
    return counts.agg(
        part("missed", "turns", 0.0).alias("missed_utterance_rate"),
        part("short_found", "short", 100.0).alias("short_utterance_recall"),
        part("complete", "turns", 0.0).alias("sentence_completeness"),
        part("merged", "outputs", 0.0).alias("cross_speaker_merge_rate"),
        F.round(100 * F.avg("coverage"), 2).alias("mean_coverage"),
    )


def turn_scores(truth: DataFrame, outputs: DataFrame, seconds: float = 0.5) -> DataFrame:
    """(session_id, speaker_turn_precision, speaker_turn_recall) of changes of the speaker, in percent; a change is found within ``seconds``.

    A session whose truth has no change has 100 for both without any, else a
    precision of 0 and a recall of 100.
    """
    w = Window.partitionBy("session_id").orderBy("start_s", "end_s", "speaker_id")

    def changes(turns: DataFrame) -> DataFrame:
        return turns.withColumn("_b", F.lag("speaker_id").over(w)).where(F.col("_b") != F.col("speaker_id")).select("session_id", F.col("start_s").alias("at_s"))

    def found(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        hit = within_tolerance(a, b, seconds).withColumn("hit", F.lit(1))
        each = a.join(hit, ["session_id", "at_s"], "left").groupBy("session_id")
        return each.agg(F.count("*").alias(f"{name}_n"), F.count("hit").alias(f"{name}_hit"))

    r, h = changes(truth), changes(outputs)
    sessions = truth.select("session_id").union(outputs.select("session_id")).distinct()
    both = sessions.join(found(r, h, "r"), "session_id", "left").join(found(h, r, "h"), "session_id", "left").na.fill(0, ["r_n", "r_hit", "h_n", "h_hit"])
    precision = F.when(F.col("h_n") > 0, 100 * F.col("h_hit") / F.col("h_n")).otherwise(F.when(F.col("r_n") > 0, 0.0).otherwise(100.0))
    recall = F.when(F.col("r_n") > 0, 100 * F.col("r_hit") / F.col("r_n")).otherwise(100.0)
    return both.select("session_id", F.round(precision, 2).alias("speaker_turn_precision"), F.round(recall, 2).alias("speaker_turn_recall"))


def scorecard(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """Eleven percentages for each session: errors of words, characters and speakers, missed words and utterances, short ones found, turns, completeness, merged speakers, coverage.

    The texts of a session are joined in the order of their start.  Sessions
    of one side only have a row too.
    """
    def text(turns: DataFrame, name: str) -> DataFrame:
        said = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "end_s", strip(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), lambda t: t != "")
        return turns.groupBy("session_id").agg(F.array_join(said, " ").alias(name))

    texts = text(truth, "_ref").join(text(outputs, "_hyp"), "session_id", "full").na.fill("", ["_ref", "_hyp"])
    rated = with_word_error_rate(texts, "_ref", "_hyp").withColumn("cer", character_error_rate(F.col("_ref"), F.col("_hyp"))).select("session_id", "wer", "cer")
    speakers = diarization_errors(truth, outputs).select("session_id", "der")
    percent = lambda c: F.round(100 * F.col(c), 2)
    share = lambda a, b, empty: F.round(F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b)).otherwise(empty), 2)
    every = evaluate(truth, outputs).join(rated, "session_id", "left").join(speakers, "session_id", "left").join(turn_scores(truth, outputs), "session_id", "left")
    return every.select(
        "session_id", percent("wer").alias("wer"), percent("cer").alias("cer"), F.coalesce(percent("der"), F.lit(0.0)).alias("der"), F.round(100 * (1 - F.col("coverage")), 2).alias("missed_word_rate"),
        share("missed", "turns", 0.0).alias("missed_utterance_rate"), share("short_found", "short", 100.0).alias("short_utterance_recall"), "speaker_turn_precision", "speaker_turn_recall",
        share("complete", "turns", 0.0).alias("sentence_completeness"), share("merged", "outputs", 0.0).alias("cross_speaker_merge_rate"), percent("coverage").alias("source_dialogue_coverage"),
    )
