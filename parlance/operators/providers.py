"""Recognition and translation as exchangeable providers.

A provider is a function on pandas Series that is made once for a task, so a
model is loaded once; deterministic stand-ins serve for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anomaly, strip

Translator = Callable[[pd.Series], pd.Series]
Recognizer = Callable[[pd.Series], pd.DataFrame]
RECOGNIZED = "text string, confidence double, avg_logprob double, no_speech_prob double"


def local_only(url: str) -> bool:
    """Whether a service's address is on this machine: by its host, not by how the text begins."""
    parts = urlparse(url)
    return parts.scheme == "http" and parts.hostname in ("127.0.0.1", "localhost")


def dictionary(words: dict[str, str]) -> Callable[[], Translator]:
    """A stand-in that translates word by word."""
    return lambda: lambda texts: texts.map(lambda t: " ".join(words.get(w, w) for w in t.split()))


def _translated(make: Callable[[], Translator], c: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for texts in batches:
            out: list[str | None] = []
            try:
                out = list(f(texts.fillna("")))
            except Exception:  # one by one, so that a text that fails costs no other
                for t in texts.fillna(""):
                    try:
                        out.append(f(pd.Series([t])).iloc[0])
                    except Exception:
                        out.append(None)
            yield pd.Series(out, dtype=object)

    return run(c)


def translate(df: DataFrame, providers: dict[tuple[str, str], Callable[[], Translator]], spare: Callable[[], Translator] | None = None, target: str = "es") -> DataFrame:
    """``df`` (text, language, is_complete, is_interrupted) with translated.

    Text of the target language, incomplete or interrupted text stays as it
    is.  A pair's provider translates, else ``spare``; where one fails, the
    spare, and then the text itself.  Each provider gets its own rows only.
    """
    keep = ~F.col("is_complete") | F.col("is_interrupted") | (F.col("language") == target) | (strip(F.col("text")) == "")
    kept = F.coalesce(keep, F.lit(True))
    parts = [df.where(kept).withColumn("translated", F.col("text"))]
    known = [s for s, t in providers if t == target]
    for source in known:
        parts.append(df.where(~kept & (F.col("language") == source)).withColumn("translated", _translated(providers[source, target], F.col("text"))))
    parts.append(df.where(~kept & ~F.col("language").isin(known)).withColumn("translated", F.lit(None).cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if spare is None:
        return out.withColumn("translated", F.coalesce("translated", "text"))
    good, bad = out.where("translated is not null"), out.where("translated is null")
    return good.unionByName(bad.withColumn("translated", F.coalesce(_translated(spare, F.col("text")), F.col("text"))))


def recognized(make: Callable[[], Recognizer]):
    """A recognizer as a function of a samples column; what fails gives a null text and costs no other."""
    names = [c.split()[0] for c in RECOGNIZED.split(", ")]

    @F.pandas_udf(RECOGNIZED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for a in batches:
            try:
                yield f(a)[names]
            except Exception:  # one by one, so that a segment that fails costs no other
                rows = []
                for x in a:
                    try:
                        rows.append(f(pd.Series([x]))[names])
                    except Exception:
                        rows.append(pd.DataFrame([(None,) * len(names)], columns=names))
                yield pd.concat(rows, ignore_index=True).astype({"text": object, "confidence": float, "avg_logprob": float, "no_speech_prob": float})

    return run


def retry(df: DataFrame, make: Callable[[], Recognizer], audio: str = "audio") -> DataFrame:
    """``df`` (text, confidence, avg_logprob, no_speech_prob, audio) with odd results recognized again.

    Only rows that fail a check are given to the recognizer.  Its text counts
    if there is any, and it passes the checks or is surer by over 0.1.
    """
    checked = df.withColumn("why", anomaly(F.col("text"), F.col("confidence"), F.col("avg_logprob"), F.col("no_speech_prob")))
    fine = F.col("why").isin("ok", "empty")

    again = recognized(make)
    new = checked.where(~fine).withColumn("new", again(F.col(audio)))
    passes = anomaly(F.col("new.text"), F.col("new.confidence"), F.col("new.avg_logprob"), F.col("new.no_speech_prob")) == "ok"
    better = (strip(F.coalesce("new.text", F.lit(""))) != "") & (passes | (F.col("new.confidence") > F.col("confidence") + 0.10))
    mended = new.withColumn("recovered", better)
    for c in ("text", "confidence", "avg_logprob", "no_speech_prob"):
        mended = mended.withColumn(c, F.when(F.col("recovered"), F.col(f"new.{c}")).otherwise(F.col(c)))
    return checked.where(fine).withColumn("recovered", F.lit(False)).unionByName(mended.drop("new"))
