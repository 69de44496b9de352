"""Voice activity on streams: a session's frames that are not told yet are kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.voice import OUTPUT, Detector, answer, levels, options_of
from . import timeout

STATE = "ring array<struct<n: int, level: double>>, frames array<struct<n: int, level: double>>, speaking boolean, silent long, processed long, voiced long, count int"


def detect_stream(frames: DataFrame, profile: str | None = None, idle_ms: int | None = None, **options) -> DataFrame:
    """Segments as the pauses after them arrive, and after each batch of a session a row of progress.

    Batches come in order for a session.  A row with null samples ends its
    session and closes the open segment, as the batch operator does at its
    end; so does a silence of ``idle_ms`` of the clock without any row, which
    bounds the state.  The state is two numbers for each frame of the open
    segment, at most the longest segment.
    """
    chosen = options_of(profile, **options)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector(**chosen)
        if state.exists:
            ring, held, d.speaking, d.silent, d.processed, d.voiced, d.count = state.get
            d.ring, d.frames = ([(x["n"], x["level"]) for x in some] for some in (ring, held))
        if state.hasTimedOut:
            rows = [*d.flush(), d.progress()]
            state.remove()
            yield answer(key[0], rows)
            return
        pdf = pd.concat(list(batches)).sort_values("frame_seq", kind="stable")
        rows = [x for r in pdf[~pdf["ended"]].itertuples() for x in d.add(int(r.n), float(r.level))]
        if pdf["ended"].any():
            rows += d.flush()
            if state.exists:
                state.remove()
        else:
            both = [[{"n": int(n), "level": float(x)} for n, x in some] for some in (d.ring, d.frames)]
            state.update((*both, d.speaking, int(d.silent), int(d.processed), int(d.voiced), int(d.count)))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield answer(key[0], [*rows, d.progress()])

    small = levels(frames.withColumn("ended", frames.samples.isNull()), "ended")
    return small.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout(idle_ms))
