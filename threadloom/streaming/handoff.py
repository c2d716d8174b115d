"""A value that one step leaves for a later one: it lasts for a time, and is taken once.

The state, a key for each session, holds the last value and when it was left; a take clears
it. Rows are (session_id, at, op, value), op ``put`` or ``take``, in the order of ``at``
within a batch. Time is that of the rows, so a replay takes the same; a value that nobody
takes stays in the state, one for a session at most. The state needs Spark's RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: how long a value lasts, an hour.
LASTS_MS = 3_600_000

TAKEN = "session_id string, at timestamp, value string"


class Handoff(StatefulProcessor):
    def __init__(self, lasts_ms: int):
        self.lasts_ms = lasts_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "value string, ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ms, r.op)):
            if r.op == "put":
                self.left.update((r.value, r.ms))
            elif r.op == "take":
                value, since = self.left.get() if self.left.exists() else (None, r.ms)
                self.left.clear()
                yield Row(session_id=key[0], at=r.at, value=value if r.ms - since <= self.lasts_ms else None)

    def close(self) -> None:
        """Nothing is held besides the state."""


def taken(rows: DataFrame, lasts_ms: int = LASTS_MS) -> DataFrame:
    """A row for each take: the value that was left for the session, null if there is none, it was taken, or it is too old.

    Rows without a session or a time are left out; of a put and a take at one time the put is first.
    """
    kept = rows.filter(F.col("session_id").isNotNull() & F.col("at").isNotNull()).withColumn("ms", F.unix_millis("at"))
    return kept.groupBy("session_id").transformWithState(statefulProcessor=Handoff(lasts_ms), outputStructType=TAKEN, outputMode="Append", timeMode="None")
