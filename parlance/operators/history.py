"""Stored sessions and captions: search, previews, states and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def valid(captions: DataFrame) -> DataFrame:
    """Captions with finite times, a start of zero or more, and an end after it."""
    finite = ~F.isnan("start_s") & ~F.isnan("end_s") & (F.col("end_s") < float("inf"))
    return captions.where(finite & (F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s")))


def search(sessions: DataFrame, captions: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Sessions whose name or any caption holds ``query``, in any case, with the number of their captions.

    The newest first, by id where times are equal; an empty query finds all.
    """
    counts = captions.groupBy("session_id").agg(F.count("*").alias("captions"))
    found = sessions
    if query:
        needle = F.lit(query.lower())
        hit = captions.where(F.instr(F.lower("original"), query.lower()) > 0).select("session_id").distinct()
        named = sessions.where(F.contains(F.lower("name"), needle)).select("session_id")
        found = sessions.join(hit.unionByName(named).distinct(), "session_id", "left_semi")
    return found.join(counts, "session_id", "left").withColumn("captions", F.coalesce("captions", F.lit(0))).orderBy(F.desc("created"), "session_id").limit(limit)


def first_captions(captions: DataFrame, limit: int) -> DataFrame:
    """The first captions of each session, by id."""
    order = Window.partitionBy("session_id").orderBy("id")
    return captions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def latest_state(events: DataFrame) -> DataFrame:
    """The last state of each session: (session_id, ts, state) events, of equal times the greater state."""
    return events.groupBy("session_id").agg(F.max(F.struct("ts", "state")).alias("last")).select("session_id", "last.state", "last.ts")


def export(captions: DataFrame, kind: str, speakers: bool = False) -> DataFrame:
    """(session_id, document): the captions of each session as srt, vtt, txt or json, in the order of ids."""
    if kind not in ("srt", "vtt", "txt", "json"):
        raise ValueError("unknown format")
    order = Window.partitionBy("session_id").orderBy("id")
    c = captions.withColumn("n", F.row_number().over(order))
    who = F.when(F.col("speaker_id").isNotNull() & F.lit(speakers), F.col("speaker_id"))
    shown = T.collapse(F.col("original"))
    if kind in ("srt", "vtt"):
        sep = "," if kind == "srt" else "."
        line = F.concat(F.coalesce(F.concat(who, F.lit(": ")), F.lit("")), shown)
        line = T.html_escape(line) if kind == "vtt" else line
        entry = F.concat(F.col("n").cast("string"), F.lit("\n"), T.timestamp(F.col("start_s"), sep), F.lit(" --> "), T.timestamp(F.col("end_s"), sep), F.lit("\n"), line, F.lit("\n"))
        head, join, tail = ("WEBVTT\n\n" if kind == "vtt" else ""), "\n", "\n"
    elif kind == "txt":
        mark = F.coalesce(F.concat(F.lit("["), who, F.lit("] ")), F.lit(""))
        entry = F.concat(F.lit("["), T.timestamp(F.col("start_s")), F.lit("] "), mark, F.col("original"), F.lit("\n→ "), mark, F.col("original"))
        head, join, tail = "", "\n\n", "\n"
    else:
        entry = F.to_json(F.struct("start_s", "end_s", "original", "speaker_id"))
        head, join, tail = "[", ",\n", "]"
    parts = c.select("session_id", "n", entry.alias("entry")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("parts"))
    return parts.select("session_id", F.concat(F.lit(head), F.array_join(F.transform("parts", lambda x: x["entry"]), join), F.lit(tail)).alias("document"))
