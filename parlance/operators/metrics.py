"""Error rates of transcripts and speakers, and latencies."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the reference's characters, without outer space and case; 0 or 1 for an empty reference."""
    r, h = F.lower(T.strip(F.coalesce(reference, F.lit("")))), F.lower(T.strip(F.coalesce(hypothesis, F.lit(""))))
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def _as_characters(words: Column, known: Column) -> Column:
    """Each word as one character, its number among ``known``; so edits of words are edits of characters."""
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.hex(F.lit(0x3400) + F.array_position(known, w))), "UTF-16BE")), "")


def with_word_error_rate(df: DataFrame, reference: str, hypothesis: str, out: str = "wer") -> DataFrame:
    """``df`` with edits of words over the reference's words; for up to 20,000 distinct words in the two texts.

    Words are columns of their own first: inside a lambda they would be found again for every word.
    """
    words = df.select("*", T.tokens(F.coalesce(F.col(reference), F.lit(""))).alias("_r"), T.tokens(F.coalesce(F.col(hypothesis), F.lit(""))).alias("_h"))
    known = words.withColumn("_known", F.array_distinct(F.concat("_r", "_h")))
    edits = F.levenshtein(_as_characters(F.col("_r"), F.col("_known")), _as_characters(F.col("_h"), F.col("_known")))
    rate = F.when(F.size("_r") == 0, F.when(F.size("_h") == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size("_r"))
    return known.withColumn(out, rate).drop("_r", "_h", "_known")


def _runs(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, turn): from each begin on, the last turn that covers the cells, or -1; turns come in order of their precedence."""
    order = np.argsort(first, kind="stable")
    edges = np.unique(np.concatenate([first, stop]))
    heap: list[int] = []
    owner, k = np.full(len(edges), -1), 0
    for i, edge in enumerate(edges):
        while k < len(order) and first[order[k]] <= edge:
            heapq.heappush(heap, -int(order[k]))
            k += 1
        while heap and stop[-heap[0]] <= edge:
            heapq.heappop(heap)
        if heap:
            owner[i] = -heap[0]
    return edges, owner


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, step: float = 0.02) -> DataFrame:
    """(session_id, speech, missed, false_alarm, confused, der) in cells of ``step`` seconds.

    Where turns overlap, the later one (by start, then end, then speaker) has
    the cell; a turn without a speaker has its cells for none.  Cells are
    counted as runs between the turns' edges and never made, so a session
    costs its turns and not its seconds.
    """
    def turns(df: DataFrame, name: str) -> DataFrame:
        first, stop = F.floor(F.col("start_s") / step), F.ceil(F.col("end_s") / step)
        return df.select("session_id", "start_s", "end_s", "speaker_id", first.alias("first"), stop.alias("stop"), F.lit(name).alias("side")).where("stop > first")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_s", "end_s", "speaker_id"], kind="stable", na_position="first")
        codes = pd.factorize(pdf["speaker_id"])[0]
        sides = []
        for name in ("r", "h"):
            own = (pdf["side"] == name).to_numpy()
            edges, owner = _runs(pdf["first"].to_numpy(np.int64)[own], pdf["stop"].to_numpy(np.int64)[own])
            sides.append((edges, np.append(codes[own], -1)[owner]))
        every = np.unique(np.concatenate([e for e, _ in sides]))
        who = []
        for edges, speakers in sides:
            at = np.searchsorted(edges, every, "right") - 1
            who.append(np.where(at >= 0, np.append(speakers, -1)[at], -1))
        cells = np.diff(every, append=every[-1:])
        r, h = who
        speech, missed, false, confused = (int(cells[m].sum()) for m in (r >= 0, (r >= 0) & (h < 0), (r < 0) & (h >= 0), (r >= 0) & (h >= 0) & (r != h)))
        return pd.DataFrame([(key[0], speech, missed, false, confused)], columns=["session_id", "speech", "missed", "false_alarm", "confused"])

    sums = turns(reference, "r").unionByName(turns(hypothesis, "h")).groupBy("session_id").applyInPandas(run, "session_id long, speech long, missed long, false_alarm long, confused long")
    return sums.withColumn("der", F.when(F.col("speech") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confused")) / F.col("speech")).otherwise(0.0))


def latency_summary(samples: DataFrame, key: str, order: str, value: str, last: int = 100) -> DataFrame:
    """Mean, 95th percentile (exact, between neighbours) and maximum of the last samples of each key."""
    recent = samples.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rank") <= last)
    return recent.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"), F.count("*").alias("samples"))


def running_latency(items: DataFrame, key: str, order: str, *stages: str) -> DataFrame:
    """(key, processed, last_<stage>, avg_<stage>) of latencies in seconds: the last and the mean of each stage in ms, to one place."""
    last = lambda c: F.round(F.max_by(F.col(c) * 1000, order), 1).alias(f"last_{c}")
    mean = lambda c: F.round(F.avg(F.col(c) * 1000), 1).alias(f"avg_{c}")
    return items.groupBy(key).agg(F.count("*").alias("processed"), *[f(c) for c in stages for f in (last, mean)])


def missing_words(reference: Column, hypothesis: Column) -> Column:
    """Of two arrays of words, those of the first that the second lacks, in order, repeats kept."""
    return F.filter(reference, lambda w: ~F.array_contains(hypothesis, w))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)
