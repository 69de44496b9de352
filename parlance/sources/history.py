"""The history of sessions and their captions as tables of a folder that only grow.

A session is a row, its states are events of which the latest counts, and
captions are appended; so writers never rewrite what is there, and a batch that
is written again after a failure replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import latest_state

SESSION = "session_id string, created timestamp, name string, mode string, source string, target string, model string"
STATE = "session_id string, ts timestamp, state string"
CAPTION = "session_id string, id long, start_s double, end_s double, original string, translated string, language string, speaker_id string"
#: State of a session that has begun.
OPEN = "en curso"


class HistoryStore:
    """Sessions, states and captions below a folder, in Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table, in which older files may lack newer columns; a table that nothing was written to is empty."""
        wanted = T._parse_datatype_string(schema)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], wanted)
        there = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")
        extra = [f for f in there.schema.fields if f.name not in wanted.names]
        return self.spark.read.schema(T.StructType(wanted.fields + extra)).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")

    def create(self, name: str, mode: str, source: str | None, target: str, model: str, at: datetime | None = None) -> str:
        """A new session's id."""
        session, now = uuid.uuid4().hex, at or datetime.now(UTC)
        self._append("sessions", [(session, now, name, mode, source, target, model)], SESSION)
        self._append("states", [(session, now, OPEN)], STATE)
        return session

    def add(self, session: str, captions: Iterable[tuple]) -> None:
        """Appends captions (start_s, end_s, original, translated, language, speaker_id) after those there; one that isn't valid is an error."""
        rows = list(captions)
        for start, end, *_ in rows:
            if not (0 <= start < end < float("inf")):
                raise ValueError(f"no valid times: {start} to {end}")
        last = self.captions(session).agg(F.max("id")).first()[0]
        begin = 0 if last is None else last + 1
        self._append("captions", [(session, begin + i, *r) for i, r in enumerate(rows)], CAPTION)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch that appends rows with the columns of captions; a batch that comes again replaces itself."""
        names = [f.name for f in T._parse_datatype_string(CAPTION).fields]

        def write(batch: DataFrame, number: int) -> None:
            batch.select(*names).write.mode("overwrite").parquet(f"{self.folder}/captions/batch-{number}")

        return write

    def finish(self, session: str, state: str, at: datetime | None = None) -> None:
        self._append("states", [(session, at or datetime.now(UTC), state)], STATE)

    def sessions(self) -> DataFrame:
        """All sessions with their latest state."""
        return self._read("sessions", SESSION).join(latest_state(self._read("states", STATE)).drop("ts"), "session_id", "left")

    def captions(self, session: str | None = None, limit: int | None = None) -> DataFrame:
        """Captions in the order of their ids, of one session or of all."""
        found = self._read("captions", CAPTION)
        if session is not None:
            found = found.where(F.col("session_id") == session)
        ordered = found.orderBy("session_id", "id")
        return ordered if limit is None else ordered.limit(limit)

    def orphans(self) -> DataFrame:
        """Captions whose session is not there."""
        return without_session(self._read("captions", CAPTION), self._read("sessions", SESSION))


def without_session(captions: DataFrame, sessions: DataFrame) -> DataFrame:
    return captions.join(sessions.select("session_id"), "session_id", "left_anti")
