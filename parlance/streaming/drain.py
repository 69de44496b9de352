"""Shutdown in order: each stage takes all that the one before has written, then ends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql.streaming.readwriter import DataStreamWriter


def drain(stages: Sequence[tuple[str, Callable[[], DataStreamWriter]]], seconds: float | None = 30.0) -> None:
    """Runs (name, writer) stages one after another until each has read all there is.

    A stage's writer is made when its turn comes, so it sees what the stages
    before have written.  One that takes over ``seconds`` is stopped and is a
    TimeoutError; what it has done is in its checkpoint, so a later drain goes
    on from there and nothing is lost or done twice.
    """
    for name, make in stages:
        query = make().trigger(availableNow=True).start()
        if not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"{name} was not done in {seconds} s")
