"""Session files as rows: every line with its place in the file and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import public_json, record_id, trimmed

#: Longest line kept, in bytes.
LINE_BYTES = 16 * 1024 * 1024
# The kinds of lines of a history.
KINDS = ("user", "assistant", "system", "result", "progress", "file-history-snapshot")
BLOCK = "array<struct<type string, text string, id string, name string, input string, tool_use_id string, content string, is_error boolean, thinking string, source string>>"
LINE = (
    "type string, sessionId string, timestamp string, uuid string, parentUuid string, isSidechain boolean, userType string, cwd string, version string, requestId string, costUSD double, duration double, isError boolean,"
    " result string, subagentId string, message struct<role: string, id: string, model: string, stop_reason: string, stop_sequence: string, usage: string, content: string>"
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the session files below path; files over 2 GiB can't be read as one row."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return read.select("path", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("content"), "modificationTime", "length")


def lines(df: DataFrame, require_newline: bool = False, most_bytes: int = LINE_BYTES) -> DataFrame:
    """(path, line_number, byte_start, byte_end, value, status) of each line of (path, content).

    status: ok, blank or oversized (value null). With require_newline a last line that no
    newline ends is left out, for it may still grow; byte_end counts the newline.
    """
    split = df.select("path", F.posexplode(F.split("content", "\n", -1)).alias("_at", "value"), (F.size(F.split("content", "\n", -1)) - 1).alias("_last"))
    size = F.octet_length("value").cast("long")
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("byte_start", F.coalesce(F.sum(size + 1).over(before), F.lit(0)))
    ended = F.col("_at") < F.col("_last")
    placed = placed.filter(ended | (~F.lit(require_newline) & (F.col("value") != "")))
    status = F.when(size > most_bytes, "oversized").when(trimmed(F.col("value")) == "", "blank").otherwise("ok")
    return placed.select(
        "path", (F.col("_at") + 1).cast("long").alias("line_number"), "byte_start", (F.col("byte_start") + size + ended.cast("int")).alias("byte_end"),
        F.when(status != "oversized", F.col("value")).alias("value"), status.alias("status"),
    )


def source_of(path: Column) -> Column:
    """struct(source_kind, source_id, session_id) from a session file's path."""
    stem, parent = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    sub = parent == "subagents"
    return F.struct(F.when(sub, "subagent").otherwise("main").alias("source_kind"), F.when(sub, stem).otherwise("main").alias("source_id"), F.when(sub, F.regexp_extract(path, r"([^/]+)/subagents/[^/]+$", 1)).otherwise(stem).alias("session_id"))


def is_object(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json).isNotNull(), F.lit(False))


def history(df: DataFrame) -> DataFrame:
    """Lines with their parsed history row (h) and a status that tells valid from unknown, degraded and malformed.

    A session id that is absent (not null) is filled in from the file's name.
    """
    own = df.withColumn("_src", source_of(F.col("path"))).select("*", "_src.*").drop("_src")
    text = trimmed(F.regexp_replace("value", "^\\x{FEFF}", ""))
    object_ = is_object(text)
    parsed = F.from_json(text, LINE)
    keys = F.json_object_keys(text)
    session = F.when(F.array_contains(keys, "sessionId"), parsed["sessionId"]).otherwise(F.col("session_id"))
    h = parsed.withField("sessionId", session)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    spoken = parsed["type"].isin("user", "assistant")
    fits = some(session) & some(parsed["timestamp"]) & some(parsed["uuid"]) & (~spoken | (F.coalesce(parsed["message"]["role"], F.lit("")) == parsed["type"]))
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.try_parse_json(text).isNull(), "malformed")
        .when(~object_, "skipped")
        .when(~F.coalesce(parsed["type"].isin(*KINDS), F.lit(False)), "unknown")
        .when(fits, "history")
        .otherwise("degraded_history")
    )
    return own.withColumn("h", F.when(object_, h)).withColumn("status", status)


def raw_records(df: DataFrame) -> DataFrame:
    """One record for each history, degraded or unknown line, in the order of a full read: (timestamp, id)."""
    h = F.col("h")
    id_ = record_id(F.coalesce(h["sessionId"], F.col("session_id")), F.col("source_id"), h["uuid"], F.col("byte_start"), F.col("byte_end"), F.col("value"))
    kept = df.filter(F.col("status").isin("history", "degraded_history", "unknown"))
    out = kept.select(id_.alias("id"), "session_id", F.col("path").alias("source_path"), "source_kind", "source_id", "line_number", "byte_start", "byte_end", h["timestamp"].alias("timestamp"), h["uuid"].alias("uuid"), h["parentUuid"].alias("parent_uuid"), h["type"].alias("type"), "status", trimmed(F.col("value")).alias("raw_line"))
    return out.orderBy(F.coalesce("timestamp", F.lit("")), "id")


# Fixed value: what stands for a line in public.
PUBLIC_LINE = "[REDACTED:RAW_TRANSCRIPT_LINE]"


def public_records(records: DataFrame, unsafe: bool = False) -> DataFrame:
    """The records of raw_records (or of a tail) with payload, the line's JSON, fit to be shown: no line, and no string value in the payload.

    unsafe: line and payload as they are.
    """
    if unsafe:
        return records.withColumn("payload", F.col("raw_line"))
    return records.withColumns({"payload": public_json(F.col("raw_line")), "raw_line": F.lit(PUBLIC_LINE)})


def sessions(df: DataFrame, after: str | None = None, before: str | None = None, limit: int = 0) -> DataFrame:
    """Discovery over (path, content): session, start time (the first within 4,096 characters), has_subagents; newest first."""
    own = df.withColumn("_src", source_of(F.col("path")))
    head = F.split(F.substring("content", 1, 4096), "\n", -1)
    start = F.try_element_at(F.filter(F.transform(head, lambda x: F.get_json_object(x, "$.timestamp")), lambda t: t.isNotNull()), F.lit(1))
    mains = own.filter(F.col("_src.source_kind") == "main").select(F.col("_src.session_id").alias("session_id"), "path", start.alias("start_time"))
    subs = own.filter(F.col("_src.source_kind") == "subagent").select(F.col("_src.session_id").alias("session_id")).distinct().withColumn("has_subagents", F.lit(True))
    found = mains.filter("start_time is not null").join(subs, "session_id", "left").fillna(False, ["has_subagents"])
    if after:
        found = found.filter(F.try_to_timestamp("start_time") > F.to_timestamp(F.lit(after)))
    if before:
        found = found.filter(F.try_to_timestamp("start_time") < F.to_timestamp(F.lit(before)))
    found = found.orderBy(F.desc("start_time"), "session_id")
    return found.limit(limit) if limit > 0 else found
