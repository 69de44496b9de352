"""Tables of a folder, and conversations as timed captions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations as captions: a turn begins every ten seconds and lasts 50 ms a character."""
    t = table(spark, folder, "conversations")
    start = F.col("turn").cast("double") * 10
    return t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("role").alias("speaker_id"), F.col("text").alias("original"), start.alias("start_s"), (start + F.length("text") / F.lit(20.0)).alias("end_s"))


def glossary(text: str) -> dict[str, str]:
    """Terms of a JSON object; keys that begin with two underscores are comments; broken JSON gives none."""
    try:
        read = json.loads(text)
    except ValueError:
        return {}
    if not isinstance(read, dict):
        return {}
    return {k.strip(): str(v).strip() for k, v in read.items() if k.strip() and not k.startswith("__")}


def with_term(glossary: dict[str, str], term: str, replacement: str) -> dict[str, str]:
    """A glossary with one term more, or another replacement for it; blank ones change nothing."""
    term, replacement = term.strip(), replacement.strip()
    return glossary | {term: replacement} if term and replacement else dict(glossary)


def without_term(glossary: dict[str, str], term: str) -> dict[str, str]:
    return {k: v for k, v in glossary.items() if k != term.strip()}


def glossary_json(glossary: dict[str, str]) -> str:
    """A glossary as :func:`glossary` reads it."""
    return json.dumps(glossary, ensure_ascii=False, indent=2)


def wav_chunks(spark: SparkSession, path: str, seconds: int = 30) -> DataFrame:
    """(path, chunk, start_s, rate, samples) of 16-bit mono WAV files, in chunks; the rest at the end is one too."""
    import io
    import wave

    import numpy as np
    import pandas as pd

    def read(frames):
        for pdf in frames:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rate, n = w.getframerate(), w.getnframes()
                    for k, at in enumerate(range(0, n, rate * seconds)):
                        w.setpos(at)
                        data = np.frombuffer(w.readframes(min(rate * seconds, n - at)), "<i2").astype(np.float32) / 32768
                        rows.append((p, k, at / rate, rate, data.tolist()))
            yield pd.DataFrame(rows, columns=["path", "chunk", "start_s", "rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, chunk int, start_s double, rate int, samples array<float>")
