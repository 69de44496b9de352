"""Part of parlance."""

from pyspark.sql.streaming.state import GroupStateTimeout


def timeout(idle_ms: int | None) -> str:
    """How states end besides by a session's last row: never, or after a time of the clock without any row.

    With a limit a stream runs on without data to see it pass, so one that
    is drained (``availableNow``) has none.
    """
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
