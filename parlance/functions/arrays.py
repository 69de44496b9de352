"""Vectors and samples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors kept to 0..1; 0 for different widths or none."""
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b))))


def energy(samples: Column) -> Column:
    """Root of the mean square, 0 without samples."""
    return F.when(F.size(samples) <= 0, 0.0).otherwise(F.sqrt(dot(samples, samples) / F.size(samples)))


def mixed(system: Column, microphone: Column, gain: float = 0.9) -> Column:
    """Two channels, cut to the shorter, added and kept to -1..1."""
    n = F.least(F.size(system), F.size(microphone))
    return F.zip_with(F.slice(system, 1, n), F.slice(microphone, 1, n), lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") + gain * y.cast("double"))))


def recognition_confidence(logprob: Column, probabilities: Column) -> Column:
    """exp(mean log-probability) times the mean word probability, kept to 0..1; 1 without either."""
    mean = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x) / F.size(probabilities)
    return F.when(logprob.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(logprob) * F.when(F.size(probabilities) > 0, mean).otherwise(1.0))))


#: Of faint audio by use: peaks between which it is raised, the peak it is raised to, and the highest gain.
RECOGNITION_GAIN, MICROPHONE_GAIN, CONSOLE_GAIN = (0.001, 0.25, 0.60, 5.0), (0.001, 0.35, 0.65, 6.0), (0.005, 0.70, 0.70, 4.0)


def peak(samples: Column) -> Column:
    """The largest absolute sample; null without samples."""
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def raised(samples: Column, rule: tuple[float, float, float, float] = RECOGNITION_GAIN) -> Column:
    """Samples of faint audio raised by one gain and kept to -1..1; all other audio as it is."""
    low, high, to, most = rule
    p = peak(samples)
    gain = F.least(F.lit(most), to / p)
    louder = F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * gain)))
    return F.when((p > low) & (p < high), louder).otherwise(samples.cast("array<double>"))


def pcm16(samples: Column) -> Column:
    """Samples kept to -1..1 as 16-bit numbers, cut towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("short"))


def with_margins(samples: Column, origin: Column, start: Column, end: Column, before_s: float = 0.5, after_s: float = 0.5, rate: int = 16000) -> Column:
    """struct(samples, start_s, end_s): the part of audio from ``origin`` on that holds a region, with margins as far as there is audio.

    Without a region (null start) it is all of the audio.
    """
    first = F.greatest(F.lit(0.0), start - origin)
    last = F.greatest(first, end - origin)
    begin = F.greatest(F.lit(0), (first * rate).cast("long") - int(before_s * rate))
    stop = F.least(F.size(samples).cast("long"), (last * rate).cast("long") + int(after_s * rate))
    cut = F.struct(F.slice(samples, (begin + 1).cast("int"), F.greatest(F.lit(0), stop - begin).cast("int")).alias("samples"), (origin + begin / rate).alias("start_s"), (origin + stop / rate).alias("end_s"))
    return F.when(start.isNotNull(), cut).otherwise(F.struct(samples.alias("samples"), (origin + F.lit(0.0)).alias("start_s"), (origin + F.size(samples) / rate).alias("end_s")))


def captured_at(segment_captured: Column, segment_end: Column, event_end: Column) -> Column:
    """When the end of a part of a segment was captured, from when the segment's end was."""
    return segment_captured - F.greatest(F.lit(0.0), segment_end - event_end)
