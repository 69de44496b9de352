"""What was said before: windows over the turns of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def _turns():
    return Window.partitionBy("session_id").orderBy("start_s", "id")


def gaps(captions: DataFrame) -> DataFrame:
    """Seconds since the same speaker's turn before; null for the first."""
    before = Window.partitionBy("session_id", "speaker_id").orderBy("start_s", "id")
    return captions.withColumn("gap_s", F.col("start_s") - F.lag("end_s").over(before))


def transitions(captions: DataFrame) -> DataFrame:
    """Turns whose speaker is another than the turn's before."""
    before = F.lag("speaker_id").over(_turns())
    return captions.withColumn("previous", before).where(F.col("previous") != F.col("speaker_id"))


def recent_transitions(captions: DataFrame, most: int = 50) -> DataFrame:
    """The last ``most`` transitions of each session (:func:`transitions`)."""
    latest = Window.partitionBy("session_id").orderBy(F.desc("start_s"), F.desc("id"))
    return transitions(captions).withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= most).drop("rank")


def last_turns(captions: DataFrame, n: int = 5, seconds: float | None = None, own: bool = False) -> DataFrame:
    """Texts of the turns before, ``n`` at most, that began at most ``seconds`` ago; with ``own`` the turn itself is the last of them."""
    before = F.collect_list(F.struct("start_s", "original")).over(_turns().rowsBetween(1 - n if own else -n, 0 if own else -1))
    recent = before if seconds is None else F.filter(before, lambda t: t["start_s"] >= F.col("start_s") - seconds)
    return captions.withColumn("context", F.transform(recent, lambda t: t["original"]))


def other_speaker(captions: DataFrame) -> DataFrame:
    """The latest turn of any other speaker: the last of the run of turns before the speaker's own."""
    w = _turns()
    changed = F.lag("speaker_id").over(w) != F.col("speaker_id")
    before = F.when(changed, F.lag("original").over(w))
    return captions.withColumn("before", before).withColumn("reply_to", F.last("before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def as_script(captions: DataFrame, n: int = 4, seconds: float = 40.0) -> DataFrame:
    """``captions`` with script: the last ``n`` turns, itself included, as lines of [speaker]: text."""
    line = F.concat(F.lit("["), F.coalesce("speaker_id", F.lit("unknown")), F.lit("]: "), F.coalesce("original", F.lit("")))
    recent = F.collect_list(F.struct("start_s", line.alias("line"))).over(_turns().rowsBetween(1 - n, 0))
    kept = F.filter(recent, lambda t: t["start_s"] >= F.col("start_s") - seconds)
    return captions.withColumn("script", F.array_join(F.transform(kept, lambda t: t["line"]), "\n"))


def as_pairs(turns: DataFrame, n: int = 5) -> DataFrame:
    """Turns (original, translated, language, target) with pairs: the last ``n`` whose texts aren't blank, itself included, as lines of EN: text -> ES: text."""
    a, b = strip(F.coalesce("original", F.lit(""))), strip(F.coalesce("translated", F.lit("")))
    line = F.concat(F.upper("language"), F.lit(": "), a, F.lit(" -> "), F.upper("target"), F.lit(": "), b)
    whole = turns.withColumn("_whole", (a != "") & (b != ""))
    among = Window.partitionBy("session_id", "_whole").orderBy("start_s", "id").rowsBetween(1 - n, 0)
    own = whole.withColumn("_own", F.when(F.col("_whole"), F.array_join(F.collect_list(line).over(among), "\n")))
    latest = F.last("_own", ignorenulls=True).over(_turns().rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("pairs", F.coalesce(latest, F.lit(""))).drop("_whole", "_own")


def vocabulary(glossary: dict[str, str], most: int = 15) -> str | None:
    """A recognizer's prompt of the first terms of a glossary; none without terms."""
    terms = [k for k in glossary if not k.startswith("__")]
    return f"Vocabulary: {', '.join(terms[:most])}." if terms else None


def decay(gap: Column, full: float = 0.20, none: float = 0.75) -> Column:
    """1 up to a gap of ``full`` seconds, 0 from ``none`` on, and a line between."""
    return F.when(gap <= full, 1.0).when(gap >= none, 0.0).otherwise((none - gap) / (none - full))


def shown_turns(captions: DataFrame, most: int = 2, seconds: float = 14.0) -> DataFrame:
    """(session_id, id, shown): the turns on display when each one has come, the oldest first.

    A speaker's turn that repeats the last one, or begins with it, takes its
    place; turns older than ``seconds`` go; ``most`` stay.  Time is the turns'
    own.  A session is folded in order by one task; turns without text change
    nothing but age.
    """
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, kept = [], []
        for r in pdf.sort_values(["start_s", "id"], kind="stable").itertuples():
            text = (r.original or "").strip()
            if text:
                last = kept[-1] if kept else None
                if last and last[0] == r.speaker_id and text.lower().startswith(last[1].lower()):
                    kept[-1] = (r.speaker_id, last[1] if text.lower() == last[1].lower() else text, r.start_s)
                else:
                    kept = [*kept, (r.speaker_id, text, r.start_s)][-most:]
            rows.append((key[0], r.id, [t for _, t, at in kept if r.start_s - at <= seconds]))
        return pd.DataFrame(rows, columns=["session_id", "id", "shown"])

    return captions.groupBy("session_id").applyInPandas(run, "session_id long, id long, shown array<string>")
