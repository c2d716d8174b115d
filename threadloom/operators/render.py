"""Sessions as JSON lines and Markdown: a column per message, joined per session in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import duration_label, truncated


def jsonl(df: DataFrame) -> DataFrame:
    """One JSON object a row, absent values left out; write it with .write.text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def clock(timestamp: Column) -> Column:
    return F.date_format(F.try_to_timestamp(timestamp), "HH:mm")


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def _time(shown: bool) -> Column:
    return F.concat(F.lit("["), clock(F.col("timestamp")), F.lit("] ")) if shown else F.lit("")


def message(times: bool = True, tools: bool = True) -> Column:
    """A message's Markdown."""
    side = F.when(F.col("is_sidechain"), " *(sidechain)*").otherwise("")
    user = F.col("role") == "user"
    head = F.concat(F.lit("### "), _time(times), F.when(user, "User").otherwise("Assistant"), side, F.lit("\n"))
    calls = F.when(~user & F.lit(tools) & (F.size("tool_calls") > 0), F.concat(F.lit("*Tools:*\n"), F.array_join(F.transform("tool_calls", lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n")))
    errors = F.when(F.size("errors") > 0, F.concat(F.lit("\n*Errors:*\n"), F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- `"), e, F.lit("`"))), "\n")))
    return _lines(head, calls, F.when(user | (F.col("text") != ""), F.col("text")), errors)


def front_matter() -> Column:
    """The statistics of a header row, as a block between lines of dashes."""
    cost = F.when(F.col("cost_usd") > 0, F.format_string("$%.4f", "cost_usd")).otherwise("N/A")
    text = lambda c: F.col(c).cast("string")
    return F.array_join(F.array(
        F.lit("---"), F.concat(F.lit("session: "), text("session_id")), F.concat(F.lit("start: "), F.col("start_time")), F.concat(F.lit("end: "), F.col("end_time")), F.concat(F.lit("duration: "), duration_label(F.col("duration_ms"))),
        F.concat(F.lit("messages: "), text("user_messages"), F.lit(" user, "), text("assistant_messages"), F.lit(" assistant")), F.concat(F.lit("tools: "), text("tool_calls"), F.lit(" calls, "), text("errors"), F.lit(" errors")),
        F.concat(F.lit("cost: "), cost), F.concat(F.lit("raw_lines: "), text("total_raw_lines")), F.lit("---"),
    ), "\n")


def _ordered(rows: DataFrame, order: list[str], between: str) -> DataFrame:
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), "md"))), lambda x: x["md"]), between).alias("body"))


def _title(more: Column | None = None) -> Column:
    return F.concat(F.lit("# Session "), F.substring(F.col("session_id").cast("string"), 1, 8), more if more is not None else F.lit(""), F.lit("\n"))


def markdown(messages: DataFrame, headers: DataFrame, between: str = "\n\n") -> DataFrame:
    """(session_id, markdown): statistics, the main conversation, then a section for each subagent."""
    main = _ordered(messages.filter("subagent is null").withColumn("md", message()), ["ord"], between)
    sections = messages.filter("subagent is not null").withColumn("md", message()).groupBy("session_id", "subagent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), between).alias("md"))
    subs = _ordered(sections.withColumn("md", F.concat(F.lit("## Subagent: "), F.col("subagent"), F.lit("\n"), F.lit(between), F.col("md"))), ["subagent"], between).withColumnRenamed("body", "subs")
    joined = headers.join(main, "session_id", "left").join(subs, "session_id", "left")
    parts = F.filter(F.array(front_matter(), F.lit(""), _title(), F.col("body"), F.when(F.col("subs").isNotNull(), "\n---\n"), F.col("subs")), lambda x: x.isNotNull())
    return joined.select("session_id", F.concat(F.array_join(parts, between), F.lit("\n")).alias("markdown"))


def export_message() -> Column:
    """A message of a merged timeline; null where it is not shown."""
    user, sub = F.col("role") == "user", F.col("subagent").isNotNull()
    has_text = F.trim("text") != ""
    thought = r"(?s)\[thinking\]\n(.*?)\n\[/thinking\]\n\n(.*)"
    said = F.when(F.col("text").rlike(thought), F.concat(F.lit("<details>\n<summary>Thinking</summary>\n\n"), F.regexp_extract("text", thought, 1), F.lit("\n\n</details>\n"), F.when(F.regexp_extract("text", thought, 2) != "", F.concat(F.lit("\n"), F.regexp_extract("text", thought, 2))).otherwise(""))).when(has_text, F.col("text"))
    only_tools = ~has_text & ((F.size("tool_calls") > 0) | (F.size("tool_results") > 0))
    side = F.when(F.col("is_sidechain") & ~sub, " *(sidechain)*").otherwise("")
    head = F.when(user | ~only_tools, F.concat(F.lit("### "), _time(True), F.when(user, "User").when(sub, "Agent").otherwise("Assistant"), side, F.lit("\n")))
    calls = F.when(F.size("tool_calls") > 0, F.array_join(F.transform("tool_calls", lambda t: F.concat(F.lit("\n### Tool: "), t)), "\n"))
    result = lambda r: F.concat(F.lit("\n### "), F.coalesce(r["tool_name"], F.lit("Tool")), F.lit(" Result"), F.when(r["is_error"], " (error)").otherwise(""), F.lit("\n\n```\n"), r["content"], F.lit("\n```"))
    results = F.when(F.size("tool_results") > 0, F.array_join(F.transform("tool_results", result), "\n"))
    errors = F.when(F.size("errors") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("errors", lambda e: F.concat(F.lit("> **Error:** `"), e, F.lit("`"))), "\n")))
    shown = ~(sub & (user | ~has_text))
    return F.when(shown, _lines(head, said, calls, results, errors))


def export_markdown(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """(session_id, markdown): one timeline of the main conversation and its subagents, with a marker where the speaker's agent changes."""
    shown = messages.withColumn("md", export_message()).filter("md is not null").withColumn("_main", F.when(F.col("subagent").isNull(), 0).otherwise(1))
    order = ["timestamp", "_main", "source_id", "ord"]
    before = F.lag("subagent").over(Window.partitionBy("session_id").orderBy(*order))
    label = F.regexp_replace("subagent", "^agent-", "")
    marker = F.when(F.col("subagent").isNotNull() & ~F.col("subagent").eqNullSafe(before), F.concat(F.lit("\n---\n**Agent: "), label, F.lit("**\n\n"))).when(F.col("subagent").isNull() & before.isNotNull(), "\n---\n\n").otherwise("")
    body = _ordered(shown.withColumn("_marker", marker).withColumn("md", F.concat("_marker", "md")), order, "\n")
    day = F.concat(F.lit(" — "), F.date_format(F.try_to_timestamp("start_time"), "EEE, MMM d, yyyy"))
    return headers.join(body, "session_id", "left").select("session_id", F.concat(front_matter(), F.lit("\n\n"), _title(day), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("markdown"))


def compact_summary(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """(session_id, summary): one line of numbers, and the start of what was said."""
    user = F.col("role") == "user"
    said = messages.filter(user | (F.col("text") != "")).withColumn("md", F.when(user, F.concat(F.lit("> "), truncated(F.col("text"), 150), F.lit("\n"))).otherwise(F.concat(truncated(F.col("text"), 300), F.lit("\n"))))
    body = _ordered(said.filter("subagent is null"), ["ord"], "\n")
    id_ = F.substring(F.col("session_id").cast("string"), 1, 8)
    head = F.concat(F.lit("**Session "), id_, F.lit("** | "), duration_label(F.col("duration_ms")), F.lit(" | "), F.col("user_messages").cast("string"), F.lit(" exchanges | "), F.col("tool_calls").cast("string"), F.lit(" tool calls\n"))
    return headers.join(body, "session_id", "left").select("session_id", F.concat_ws("\n", head, "body").alias("summary"))


def file_name(session: Column, start: Column) -> Column:
    return F.concat_ws("_", F.date_format(F.try_to_timestamp(start), "yyyy-MM-dd_HHmm"), F.substring(session.cast("string"), 1, 8))
