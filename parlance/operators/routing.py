"""Segments on their way: clamped to their chunk, checked for their language, numbered, and sent on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import captured_at
from ..functions.audio import overlap_of
from ..functions.text import subtitle

#: Languages that are translated.
LANGUAGES = ("es", "en", "pt")


def clamped(segments: DataFrame) -> DataFrame:
    """Segments (start_s, end_s from their chunk's start; chunk_start_s, chunk_end_s) in the session's time, kept within the chunk; those without length go."""
    start = F.greatest(F.col("chunk_start_s"), F.col("chunk_start_s") + F.col("start_s"))
    end = F.least(F.col("chunk_end_s"), F.col("chunk_start_s") + F.col("end_s"))
    return segments.withColumns({"start_s": start, "end_s": end}).where("end_s > start_s")


def known_language(language: Column, allowed: Sequence[str] = LANGUAGES) -> Column:
    """The language; any other than the allowed ones, or none, is an error."""
    return F.when(language.isin(*allowed), language).otherwise(F.raise_error(F.concat(F.lit("another language was detected: "), F.coalesce(language, F.lit("none")))).cast("string"))


def presegmented(segments: DataFrame, detect: bool = True) -> DataFrame:
    """Captured segments (session_id, captured_s, start_s, end_s, samples, ...) with sequence_id, is_overlap and destination.

    A session's segments are numbered from 1 in the order of their capture.
    Where two voices are heard at once the destination is separation, else
    recognition.  ``detect`` False skips the look at the samples, as
    without a separator.
    """
    order = Window.partitionBy("session_id").orderBy("captured_s", "start_s", "end_s")
    both = F.lit(False) if not detect else F.coalesce(overlap_of(F.col("samples"))["has_overlap"], F.lit(False))
    marked = segments.withColumn("is_overlap", both)
    return marked.withColumn("sequence_id", F.row_number().over(order).cast("long")).withColumn("destination", destination(F.col("is_overlap")))


def destination(is_overlap: Column, separator_waits: Column | None = None) -> Column:
    """Where a segment goes: separation if two voices overlap and the separator has room, else recognition."""
    free = F.lit(True) if separator_waits is None else ~F.coalesce(separator_waits, F.lit(False))
    return F.when(F.coalesce(is_overlap, F.lit(False)) & free, "separation").otherwise("recognition")


def routed(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(for separation, for recognition) of segments with a destination; together they are all of them."""
    return segments.where("destination = 'separation'"), segments.where("destination <> 'separation'")


def subtitles(translations: DataFrame, width: int = 42) -> DataFrame:
    """Translations (translated, captured_s, shown_s, asr_s, translation_s, ...) as subtitles, with wrapped text and latencies.

    ``total_latency`` is from the capture of the utterance's end to its display; a clock that runs back gives 0.
    """
    total = F.greatest(F.lit(0.0), F.col("shown_s") - F.col("captured_s"))
    return translations.withColumns({"subtitle": subtitle(F.col("translated"), width), "total_latency": total, "asr_latency": F.coalesce("asr_s", F.lit(0.0)), "trans_latency": F.coalesce("translation_s", F.lit(0.0))})


def with_capture_times(parts: DataFrame) -> DataFrame:
    """Parts (end_s, segment_end_s, segment_captured_s) with captured_s: when each one's own end was captured."""
    return parts.withColumn("captured_s", captured_at(F.col("segment_captured_s"), F.col("segment_end_s"), F.col("end_s")))
