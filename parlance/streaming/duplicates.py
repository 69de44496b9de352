"""Repeats on streams: what a speaker said last is kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.duplicates import Heard, novel
from . import timeout


def suppress_stream(utterances: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Utterances that don't repeat a kept one, as they arrive; see :func:`operators.duplicates.suppress_repeats`.

    Batches come in order for a speaker.  The state is what a later row can
    still repeat; it goes with a row that has no start, or after ``idle_ms``
    of the clock without any row.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [Heard(*x) for x in json.loads(state.get[0])] if state.exists else []
        pdf = pd.concat(list(frames), ignore_index=True)
        ends = pdf["start_s"].isna()
        chosen, kept = novel(pdf[~ends], kept)
        if ends.any():
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(kept),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pdf.loc[chosen]

    return utterances.groupBy("session_id", "speaker_id").applyInPandasWithState(run, utterances.schema, "kept string", "append", timeout(idle_ms))
