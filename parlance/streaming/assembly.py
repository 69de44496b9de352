"""The assembler on streams: the state of a session is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.assembly import COLUMNS, OUTPUT, Assembler, feed
from . import timeout


def assemble_stream(fragments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Utterances as their fragments arrive.

    Batches come in order for a session; a row with neither text nor progress
    ends its session and closes the open turns, as the batch operator does at
    its end.  So does a silence of ``idle_ms`` of the clock without any row,
    which bounds the state; all other times are of the audio.
    """
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Assembler.of(state.get[0]) if state.exists else Assembler()
        rows, ended = [], state.hasTimedOut
        if not ended:
            pdf = pd.concat(list(frames))
            ends = pdf["text"].isna()
            if "processed_s" in pdf:
                ends &= pdf["processed_s"].isna()
            ended = ends.any()
            rows = feed(machine, pdf[~ends])
        if ended:
            rows += machine.flush()
            if state.exists:
                state.remove()
        else:
            state.update((machine.state(),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([{"session_id": key[0], **r} for r in rows], columns=COLUMNS)

    return fragments.groupBy("session_id").applyInPandasWithState(run, OUTPUT, "open string", "append", timeout(idle_ms))
