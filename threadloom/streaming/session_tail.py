"""A session's tail as blocks and records: what the batch makes of whole files, made of files as they grow.

A line needs little of the lines before it: its number, the last time that its source told,
and the names of the tools whose results it carries. This is the state, a key for each
source file. A new generation of a file starts with an empty one. Everything else is
columns, the same as of the batch.

A result is named by the calls that came before it or in the same batch; the last call of
an id names it. Blocks have stable ids, so a sink that upserts by them may see a batch
twice. The state needs the session's RocksDB store:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions.text import record_id, trimmed
from threadloom.operators.history import content_blocks, contents, typed
from threadloom.sources.jsonl import history

PLACED = "path string, generation long, byte_start long, byte_end long, value string, status string, reset string, line_number long, preceding_timestamp string, names map<string,string>"


class Sources(StatefulProcessor):
    """Numbers a source's lines, and tells each the last time before it and the names of its results' tools."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "generation long, lines long, timestamp string")
        self.tools = handle.getMapState("tools", "id string", "name string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.generation, r.byte_start))  # of one pass, or a few
        generation, lines, timestamp = self.at.get() if self.at.exists() else (-1, 0, None)
        done = 0
        while done < len(rows):
            if rows[done].generation != generation:
                generation, lines, timestamp = rows[done].generation, 0, None
                self.tools.clear()
            end = done
            while end < len(rows) and rows[end].generation == generation:
                for call in rows[end].calls or ():
                    if call["id"] is not None:
                        self.tools.updateValue((call["id"],), (call["name"] or "",))
                end += 1
            for r in rows[done:end]:
                lines += 1
                names = {i: self.tools.getValue((i,))[0] for i in r.results or () if i is not None and self.tools.containsKey((i,))}
                yield Row(path=r.path, generation=generation, byte_start=r.byte_start, byte_end=r.byte_end, value=r.value, status=r.status, reset=r.reset, line_number=lines, preceding_timestamp=timestamp, names=names)
                timestamp = r.timestamp or timestamp
            done = end
        self.at.update((generation, lines, timestamp))

    def close(self) -> None:
        """Nothing is held besides the state."""


def placed(lines: DataFrame) -> DataFrame:
    """The history rows of the stream of ``follow``, each with its line number, the last time before it, and the names of its tools."""
    parsed = history(lines.withColumn("line_status", F.col("status")))
    h = F.col("h")
    found = content_blocks(h["message"]["content"])
    valid, role = F.col("status") == "history", h["message"]["role"]
    calls = F.transform(F.filter(found, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name")))
    results = F.transform(F.filter(found, lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"])
    known = F.when(F.col("status").isin("history", "degraded_history", "unknown"), h["timestamp"])
    slim = parsed.select(
        "path", "generation", "byte_start", "byte_end", "value", F.col("line_status").alias("status"), "reset", known.alias("timestamp"),
        F.when(valid & (role == "assistant"), calls).alias("calls"), F.when(valid, results).alias("results"),
    )
    state = slim.groupBy("path").transformWithState(statefulProcessor=Sources(), outputStructType=PLACED, outputMode="Append", timeMode="None")
    return history(state).withColumn("ord", F.col("line_number"))


def tail_blocks(lines: DataFrame, sidechains: bool = False, tool_results: bool = True) -> DataFrame:
    """The blocks that the new lines bring, as ``history.blocks`` makes them, with the generation of their file."""
    each = contents(placed(lines).filter("status = 'history'"), sidechains)
    return typed(each.withColumn("tool_name", F.try_element_at("names", F.col("tool_use_id"))), tool_results, ("path", "generation"))


def tail_records(lines: DataFrame) -> DataFrame:
    """The raw records that the new lines bring, as ``jsonl.raw_records`` makes them, with their generation and effective time."""
    h, told = F.col("h"), F.nullif(F.col("h.timestamp"), F.lit(""))
    kept = placed(lines).filter(F.col("status").isin("history", "degraded_history", "unknown"))
    id_ = record_id(F.coalesce(h["sessionId"], F.col("session_id")), F.col("source_id"), h["uuid"], F.col("byte_start"), F.col("byte_end"), F.col("value"))
    return kept.select(
        id_.alias("id"), "session_id", F.col("path").alias("source_path"), "generation", "source_kind", "source_id", "line_number", "byte_start", "byte_end", h["timestamp"].alias("timestamp"),
        F.coalesce(told, F.col("preceding_timestamp"), F.lit("")).alias("effective_timestamp"), h["uuid"].alias("uuid"), h["parentUuid"].alias("parent_uuid"), h["type"].alias("type"), "status", trimmed(F.col("value")).alias("raw_line"),
    )
