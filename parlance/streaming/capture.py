"""Landed frames as a stream: two channels mixed, and a limit on what may pile up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import mixed

FRAMES = "session_id long, frame_seq long, ts timestamp, samples array<float>"
#: Seconds of audio that may wait in one session.
MOST_SECONDS = 180.0


class Backlog(RuntimeError):
    """More audio waits than may; nothing of it was dropped."""


def frames(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Frames of Parquet files that land in a folder, at most ``files`` in a batch."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(path)


def mixed_channels(system: DataFrame, microphone: DataFrame, gain: float = 0.9, late: str = "10 seconds") -> DataFrame:
    """One stream of two: frames of the same session and number, cut to the shorter, added and kept to -1..1.

    A frame waits for its partner as long as the watermark allows: both times
    within ``late`` of each other bound the state.
    """
    a = system.withWatermark("ts", late).select("session_id", "frame_seq", "ts", F.col("samples").alias("a"))
    b = microphone.withWatermark("ts", late).select(F.col("session_id").alias("_s"), F.col("frame_seq").alias("_f"), F.col("ts").alias("_t"), F.col("samples").alias("b"))
    near = (F.col("_t") >= F.col("ts") - F.expr(f"interval {late}")) & (F.col("_t") <= F.col("ts") + F.expr(f"interval {late}"))
    both = a.join(b, (F.col("session_id") == F.col("_s")) & (F.col("frame_seq") == F.col("_f")) & near)
    return both.select("session_id", "frame_seq", "ts", mixed(F.col("a"), F.col("b"), gain).cast("array<float>").alias("samples"))


def within_limit(write: Callable[[DataFrame, int], None], rate: int = 16000, most_s: float = MOST_SECONDS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that stops the stream if a session has over ``most_s`` waiting, else writes the batch.

    A stopped batch is not written and not marked as done, so a new start
    reads it again; nothing is ever left out.
    """

    def run(batch: DataFrame, number: int) -> None:
        waiting = batch.groupBy("session_id").agg((F.sum(F.size("samples")) / rate).alias("s")).agg(F.max("s")).first()[0]
        if waiting is not None and waiting > most_s:
            raise Backlog(f"{waiting:.1f} s of audio wait, {most_s:.1f} may")
        write(batch, number)

    return run


def lossy(write: Callable[[DataFrame, int], None], most: int, dropped: Accumulator) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes the first ``most`` frames of each session in a batch and counts the others in ``dropped``.

    For sources that must never wait; everything else uses :func:`within_limit`.
    """
    order = Window.partitionBy("session_id").orderBy("frame_seq")

    def run(batch: DataFrame, number: int) -> None:
        ranked = batch.withColumn("_rank", F.row_number().over(order)).persist()
        write(ranked.where(F.col("_rank") <= most).drop("_rank"), number)
        dropped.add(ranked.where(F.col("_rank") > most).count())
        ranked.unpersist()

    return run
