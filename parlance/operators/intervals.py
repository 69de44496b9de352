"""Joins on time: overlaps, tolerances, islands of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, bucket: float = 30.0) -> DataFrame:
    """Pairs of intervals of one session that overlap, with the seconds they share.

    Intervals (session_id, id, start_s, end_s) meet by the buckets of time
    they touch, in an equi-join; a pair counts in the first bucket both touch.
    """
    def split(df: DataFrame, p: str) -> DataFrame:
        named = df.select("session_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "start_s", "end_s")])
        return named.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_start_s") / bucket), F.floor(F.col(f"{p}_end_s") / bucket))))

    shared = F.least("a_end_s", "b_end_s") - F.greatest("a_start_s", "b_start_s")
    met = split(a, "a").join(split(b, "b"), ["session_id", "bucket"])
    return met.where((shared > 0) & (F.col("bucket") == F.floor(F.greatest("a_start_s", "b_start_s") / bucket))).select("session_id", "a_id", "b_id", shared.alias("seconds"))


def within_tolerance(a: DataFrame, b: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Rows (session_id, at_s) of ``a`` that have one of ``b`` within ``seconds``, joined by cells of that width."""
    near = F.explode(F.array(*[F.floor(F.col("at_s") / seconds) + k for k in (-1, 0, 1)])).alias("cell")
    other = b.select("session_id", F.floor(F.col("at_s") / seconds).alias("cell"), F.col("at_s").alias("b_at"))
    keyed = a.select("session_id", "at_s", near)
    return keyed.join(other, ["session_id", "cell"]).where(F.abs(F.col("at_s") - F.col("b_at")) <= seconds).select("session_id", "at_s").distinct()


def islands(events: DataFrame, key: str, time: str, value: str, gap: str, least: float) -> DataFrame:
    """Sessions of events whose level is at least ``least``, closed by silences of ``gap`` (such as '8 hours')."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    out = events.where(F.col(value) >= least).groupBy(key, w).agg(F.count("*").alias("events"), F.avg(value).alias("level"), F.max(time).alias("last"))
    return out.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("last"), "events", "level")


def island_numbers(events: DataFrame, key: str, time: str, gap_s: float) -> DataFrame:
    """``events`` with the number of their island: it grows where the time before is over ``gap_s`` ago."""
    w = Window.partitionBy(key).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(w) > int(gap_s * 1_000_000)).cast("int"), F.lit(1))
    return events.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def near_repeats(captions: DataFrame, seconds: float = 2.5) -> DataFrame:
    """Captions of a speaker whose normalized text stood in one that began within ``seconds`` before."""
    from ..functions.text import normalize

    w = Window.partitionBy("session_id", "speaker_id", "norm").orderBy("start_s", "id")
    return captions.withColumn("norm", normalize(F.col("original"))).withColumn("before", F.lag("start_s").over(w)).where((F.col("norm") != "") & (F.col("start_s") - F.col("before") <= seconds)).drop("norm", "before")
