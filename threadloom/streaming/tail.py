"""A streaming source that follows growing JSON-lines files, and what runs on it.

Spark's own file source sees new files only. This one's offset holds a cursor for each file
(see ``cursor``); a micro-batch has one partition per file that grew, of at most a pass's
bytes, so that a task's work is bounded and a new query catches up pass by pass. A file
that no longer fits its cursor is read again from its start as its next generation, which
the offset log keeps: (path, generation, byte_start) is a key of all rows ever read. Lines
that no newline ends yet wait for a later batch. A missing file keeps its cursor.

Files whose size, time and inode are as they were are not opened. The folder must be one
that the driver and the executors can open.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadloom.streaming.cursor import LINE_BYTES, PASS_BYTES, Cursor, Limits, advanced, lines_between

SCHEMA = "path string, generation long, byte_start long, byte_end long, value string, status string, reset string, pass_limit string"


class Span(InputPartition):
    """What one pass reads of a file."""

    def __init__(self, path: str, cursor: dict, begin: int, started: int | None):
        self.path, self.cursor, self.begin, self.started = path, cursor, begin, started


class JsonlTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        lines = int(options.get("maxpasslines", 0))
        self.limits = Limits(int(options.get("maxlinebytes", LINE_BYTES)), int(options.get("maxpassbytes", PASS_BYTES)), lines or None)
        #: The cursors up to which passes are planned. Of a query that starts again Spark tells them by partitions().
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = dict(self.known)
        for path in sorted(glob.glob(os.path.join(self.folder, "**", "*.jsonl"), recursive=True)):
            with contextlib.suppress(FileNotFoundError):
                cursor = Cursor.of(found[path]) if path in found else None
                now = os.stat(path)
                if cursor and not cursor.limit and (cursor.device, cursor.inode, cursor.size, cursor.modified) == (now.st_dev, now.st_ino, now.st_size, now.st_mtime_ns):
                    continue
                after, begin = advanced(path, cursor, self.limits)
                if cursor is None or (after.offset, after.generation, after.limit) != (cursor.offset, cursor.generation, cursor.limit) or begin != cursor.offset:
                    found[path] = after.saved()
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, self.known = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, cursor in self.known.items():
            old = before.get(path)
            same = old and old["generation"] == cursor["generation"]
            begin, started = (old["offset"], old["pending"]) if same else (0, None)
            if cursor["offset"] > begin:
                out.append(Span(path, cursor, begin, started))
        return out or [Span("", {}, 0, None)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        c = span.cursor
        with contextlib.suppress(FileNotFoundError), open(span.path, "rb") as f:
            now = os.fstat(f.fileno())
            if (now.st_dev, now.st_ino) != (c["device"], c["inode"]):
                return  # another file by now, which its own pass will read
            for start, end, line in lines_between(f, span.begin, c["offset"], span.started, self.limits.line_bytes):
                text = None if line is None else line.decode("utf8", "replace")
                status = "oversized" if text is None else "ok" if text.strip() else "blank"
                yield span.path, c["generation"], start, end, text, status, c["reset"] if span.begin == 0 else None, c["limit"]

    def commit(self, end: dict) -> None:
        """Spark's commit log holds the offsets."""


class JsonlTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JsonlTailReader:
        return JsonlTailReader(self.options)


def follow(spark: SparkSession, folder: str, most_bytes: int = LINE_BYTES, pass_bytes: int = PASS_BYTES, pass_lines: int | None = None) -> DataFrame:
    """The lines of all session files under folder as a stream.

    A trigger takes pass_bytes of a file at most, and pass_lines lines if that is given, which
    makes the driver count them; ``pass_limit`` says which limit ended the pass (null: none),
    ``reset`` why a generation began. A trigger that takes what is there once (availableNow)
    makes one pass: catch up by a processing-time trigger, or by a greater pass_bytes.
    """
    spark.dataSource.register(JsonlTail)
    options = {"path": folder, "maxLineBytes": str(most_bytes), "maxPassBytes": str(pass_bytes), "maxPassLines": str(pass_lines or 0)}
    return spark.readStream.format("session_jsonl").options(**options).load()


def running_stats(lines: DataFrame) -> DataFrame:
    """Per file, so far: lines, malformed lines, the last byte read. lines: the stream of follow()."""
    bad = (F.col("status") == "ok") & F.try_parse_json("value").isNull()
    return lines.groupBy("path", "generation").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("malformed"), F.max("byte_end").alias("offset"))
