"""The speaker tracker on streams: a session's profiles are kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.tracking import OUTPUT, Tracker, answer, follow
from . import timeout


def track_stream(cut: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Speakers of pieces as they arrive; all pieces of a segment come in one batch, and batches in order for a session.

    A row without a segment ends its session.  So does a silence of
    ``idle_ms`` of the clock without any row, which bounds the state.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = Tracker.of(state.get[0]) if state.exists else Tracker()
        pdf = pd.concat(list(frames))
        ends = pdf["segment"].isna()
        rows = follow(machine, pdf[~ends])
        if ends.any():
            if state.exists:
                state.remove()
        else:
            state.update((machine.state(),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield answer(key[0], rows)

    return cut.groupBy("session_id").applyInPandasWithState(run, OUTPUT, "known string", "append", timeout(idle_ms))
