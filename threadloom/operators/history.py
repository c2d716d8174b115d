"""Dialect A: messages, blocks, statistics and timelines from history lines.

Input: lines (session_id, source_kind, source_id, ord, h) with h as sources.jsonl.LINE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import image_placeholder, is_noise, redacted, retained, tool_summary, trimmed, truncated
from threadloom.sources.jsonl import BLOCK


@dataclass(frozen=True)
class Denoise:
    """What messages keep."""

    user_chars: int = 2000
    assistant_chars: int = 500
    tool_summaries: bool = True
    thinking: bool = False
    errors: bool = True
    tool_results: bool = False
    sidechains: bool = False


def content_blocks(content: Column) -> Column:
    """The blocks of a message's content, null if it is a plain text."""
    return F.when(trimmed(content).startswith("["), F.from_json(content, BLOCK))


def result_text(content: Column) -> Column:
    """A tool result's text: plain, or its text items; anything else is empty."""
    items = F.from_json(content, "array<struct<type string, text string>>")
    joined = F.array_join(F.transform(F.filter(items, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"]), "\n\n")
    return F.coalesce(F.when(trimmed(content).startswith("[") & items.isNotNull(), joined).otherwise(content), F.lit(""))


def tool_names(lines: DataFrame) -> DataFrame:
    """(session_id, source_id, tool_use_id, tool_name): the last call of an id names it."""
    calls = lines.filter(F.col("h.message.role") == "assistant").select("session_id", "source_id", "ord", F.posexplode(content_blocks(F.col("h.message.content"))).alias("_i", "b"))
    return calls.filter("b.type = 'tool_use'").groupBy("session_id", "source_id", F.col("b.id").alias("tool_use_id")).agg(F.max_by("b.name", F.struct("ord", "_i")).alias("tool_name"))


def messages(lines: DataFrame, config: Denoise = Denoise()) -> DataFrame:
    """Denoised messages: what people and the assistant said, with calls, results and errors."""
    h, sub = F.col("h"), F.col("source_kind") == "subagent"
    content, role = h["message"]["content"], h["message"]["role"]
    blocks = content_blocks(content)
    kept = lines.filter(~h["type"].isin("result", "system", "progress") & role.isin("user", "assistant"))
    if not config.sidechains:
        kept = kept.filter(sub | ~F.coalesce(h["isSidechain"], F.lit(False)))

    def said(noise: bool) -> Column:
        text = lambda b: (b["type"] == "text") & (trimmed(b["text"]) != "") & (~is_noise(b["text"]) if noise else F.lit(True))
        parts = F.transform(F.filter(blocks, lambda b: text(b) | (b["type"] == "image")), lambda b: F.when(b["type"] == "image", image_placeholder(b["source"])).otherwise(b["text"]))
        return F.when(blocks.isNotNull(), F.array_join(parts, "\n\n")).when(F.lit(noise) & is_noise(content), F.lit("")).otherwise(content)

    nothing = F.array().cast("array<string>")
    results = F.filter(blocks, lambda b: b["type"] == "tool_result")
    errors = F.transform(F.filter(results, lambda b: F.coalesce(b["is_error"], F.lit(False)) & (result_text(b["content"]) != "")), lambda b: truncated(redacted(result_text(b["content"])), 200))
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: tool_summary(b["name"], b["input"]))
    thought = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), "\n\n")
    user_text, own_text = truncated(said(True), config.user_chars), truncated(said(False), config.assistant_chars)
    if config.thinking:
        own_text = F.when(F.coalesce(thought, F.lit("")) != "", F.concat(F.lit("[thinking]\n"), truncated(thought, 1000), F.lit("\n[/thinking]\n\n"), own_text)).otherwise(own_text)
    user = role == "user"
    out = kept.select(
        "session_id", "source_id", "ord", role.alias("role"), F.coalesce(F.when(user, user_text).otherwise(own_text), F.lit("")).alias("text"), h["timestamp"].alias("timestamp"),
        F.coalesce(F.when(~user & F.lit(config.tool_summaries), calls), nothing).alias("tool_calls"), F.coalesce(F.when(user & F.lit(config.errors), errors), nothing).alias("errors"),
        F.when(user & F.lit(config.tool_results), F.filter(results, lambda b: result_text(b["content"]) != "")).alias("_results"), F.when(sub, F.col("source_id")).alias("subagent"), h["isSidechain"].alias("is_sidechain"),
    )
    if not config.tool_results:
        out = out.withColumn("tool_results", F.expr("cast(array() as array<struct<tool_use_id string, tool_name string, content string, is_error boolean>>)")).drop("_results")
    else:
        each = out.select("session_id", "source_id", "ord", F.posexplode("_results").alias("_i", "b")).withColumn("tool_use_id", F.col("b.tool_use_id"))
        named = each.join(tool_names(lines), ["session_id", "source_id", "tool_use_id"], "left")
        entry = F.struct("_i", F.struct("tool_use_id", "tool_name", retained(result_text(F.col("b.content")))["content"].alias("content"), F.col("b.is_error").alias("is_error")).alias("r"))
        grouped = named.groupBy("session_id", "source_id", "ord").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"]).alias("tool_results"))
        out = out.drop("_results").join(grouped, ["session_id", "source_id", "ord"], "left")
        out = out.withColumn("tool_results", F.coalesce("tool_results", F.expr("cast(array() as array<struct<tool_use_id string, tool_name string, content string, is_error boolean>>)")))
    return out.filter((F.col("text") != "") | (F.size("tool_calls") > 0) | (F.size("errors") > 0) | (F.size("tool_results") > 0))


def contents(lines: DataFrame, sidechains: bool = False) -> DataFrame:
    """A row for each block of a spoken line: i, its place in the unfiltered content, b, and the tool use that it is of."""
    h = F.col("h")
    own = lines.filter(h["type"].isin("user", "assistant") & h["message"].isNotNull())
    if not sidechains:
        own = own.filter((F.col("source_kind") == "subagent") | ~F.coalesce(h["isSidechain"], F.lit(False)))
    content = h["message"]["content"]
    plain = F.array(F.from_json(F.lit("{}"), BLOCK[len("array<") : -1]).withField("type", F.lit("text")).withField("text", content))
    each = own.select("*", F.posexplode(F.coalesce(content_blocks(content), plain)).alias("i", "b"))
    return each.withColumn("tool_use_id", F.when(F.col("b.type") == "tool_use", F.col("b.id")).otherwise(F.col("b.tool_use_id")))


def blocks(lines: DataFrame, sidechains: bool = False, tool_results: bool = True) -> DataFrame:
    """Typed content blocks with stable ids: uuid and the place in the unfiltered content."""
    each = contents(lines.select("session_id", "source_kind", "source_id", "ord", "h"), sidechains)
    return typed(each.join(tool_names(lines), ["session_id", "source_id", "tool_use_id"], "left"), tool_results)


def typed(each: DataFrame, tool_results: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``contents`` whose tool_name is known, and other columns of theirs."""
    h = F.col("h")
    b, role, kind = F.col("b"), F.col("h.message.role"), F.col("b.type")
    each = each.withColumn("_kept", F.when(kind == "tool_result", retained(result_text(b["content"]))))
    kept = F.col("_kept")
    says = F.when(role == "user", "user_text").otherwise("assistant_text")
    out = each.select(
        F.concat(h["uuid"], F.lit(":"), F.col("i").cast("string")).alias("id"), F.when(kind.isin("text", "image"), says).otherwise(kind).alias("type"), "session_id", h["timestamp"].alias("timestamp"), h["uuid"].alias("message_uuid"), h["parentUuid"].alias("parent_uuid"),
        F.when(F.col("source_kind") == "subagent", F.col("source_id")).alias("subagent_id"), F.when(h["isSidechain"], True).alias("is_sidechain"),
        F.when(kind == "text", b["text"]).when(kind == "image", image_placeholder(b["source"])).when(kind == "thinking", b["thinking"]).when(kind == "tool_result", kept["content"]).alias("content"),
        F.when(kind.isin("tool_use", "tool_result"), F.col("tool_use_id")).alias("tool_use_id"), F.when(kind == "tool_use", b["name"]).when(kind == "tool_result", F.col("tool_name")).alias("tool_name"),
        F.when(kind == "tool_use", tool_summary(b["name"], b["input"])).alias("summary"), F.when(kind == "tool_use", b["input"]).alias("input"),
        F.when(kind == "tool_result", kept["truncated"]).alias("truncated"), F.when((kind == "tool_result") & kept["truncated"], kept["original_line_count"]).alias("original_line_count"),
        F.when(kind == "tool_result", F.coalesce(b["is_error"], F.lit(False))).alias("is_error"), F.struct(F.when(F.col("source_kind") == "main", 0).otherwise(1).alias("sub"), "source_id", "ord", "i").alias("emit_seq"), *also,
    )
    blank = F.coalesce(trimmed(F.col("content")), F.lit("")) == ""
    spoken = F.col("type").isin("user_text", "assistant_text")
    keep = F.when(spoken, ~blank & ~is_noise(F.col("content"))).when(F.col("type") == "thinking", ~blank).when(F.col("type") == "tool_result", F.lit(tool_results) & (~blank | F.col("is_error"))).otherwise(F.col("type") == "tool_use")
    return out.filter(keep)


def boundaries(lines: DataFrame) -> DataFrame:
    """Where each subagent enters and exits: its least and greatest timestamp string."""
    spans = lines.filter("source_kind = 'subagent'").groupBy("session_id", "source_id").agg(F.min("h.timestamp").alias("enter"), F.max("h.timestamp").alias("exit"))
    return spans.select("session_id", "source_id", F.expr("stack(2, 'enter', enter, 'exit', exit) as (direction, timestamp)")).withColumn("id", F.concat("session_id", F.lit(":agent-"), "direction", F.lit(":"), "source_id"))


def stats(lines: DataFrame) -> DataFrame:
    """Per session, over all its lines: counts, errors, duration and cost."""
    h, ends = F.col("h"), F.col("h.type") == "result"
    role = F.when(~ends, h["message"]["role"])
    found = content_blocks(h["message"]["content"])
    many = lambda test: F.coalesce(F.size(F.filter(found, test)), F.lit(0))
    at = F.unix_millis(F.try_to_timestamp(h["timestamp"]))
    wrong = F.when(ends, F.coalesce(h["isError"], F.lit(False)).cast("int")).when(role == "user", many(lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False)))).otherwise(0)
    return lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_raw_lines"), F.count_if(role == "user").alias("user_messages"), F.count_if(role == "assistant").alias("assistant_messages"),
        F.sum(F.when(role == "assistant", many(lambda b: b["type"] == "tool_use")).otherwise(0)).alias("tool_calls"), F.sum(wrong).alias("errors"),
        F.coalesce(F.max(at) - F.min(at), F.lit(0)).alias("duration_ms"), F.sum(F.when(ends, F.coalesce(h["costUSD"], F.lit(0.0))).otherwise(0.0)).alias("cost_usd"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """A header row per session: statistics, first and last timestamp string, and how many subagents it has."""
    bounds = lines.groupBy("session_id").agg(F.min("h.timestamp").alias("start_time"), F.max("h.timestamp").alias("end_time"), F.count_distinct(F.when(F.col("source_kind") == "subagent", F.col("source_id"))).alias("subagents"))
    return stats(lines).join(bounds, "session_id")


def forward_filled(rows: DataFrame, keys: list[str], order: str, timestamp: str, prior: Column | None = None) -> DataFrame:
    """rows with effective_timestamp: the last one that isn't empty, within a source in file order."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("effective_timestamp", F.coalesce(F.last(F.nullif(F.col(timestamp), F.lit("")), ignorenulls=True).over(upto), prior if prior is not None else F.lit(None).cast("string"), F.lit("")))


def merged(rows: DataFrame) -> DataFrame:
    """Records of a session's sources in one order, main before subagents at equal times."""
    filled = forward_filled(rows, ["session_id", "source_id"], "byte_start", "timestamp")
    return filled.orderBy("session_id", "effective_timestamp", F.when(F.col("source_kind") == "main", 0).otherwise(1), "source_id", "byte_start", "byte_end", "id")


def fold_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replay upserts and deletes: the last of a key wins; a row's place is its first upsert since the last delete."""
    deleted = F.max(F.when(F.col("op") == "delete", F.col(order)))
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_last"), deleted.alias("_deleted"))
    first = changes.join(last.select(*keys, "_deleted"), keys).filter(F.col("_deleted").isNull() | (F.col(order) > F.col("_deleted"))).groupBy(*keys).agg(F.min(order).alias("first_order"))
    return last.filter("_last.op = 'upsert'").join(first, keys).select("_last.*", "first_order")


def summaries(turns: DataFrame) -> DataFrame:
    """(session_id, message_count, first_text) of turns (session_id, ord, role, text): spoken messages, and a user's first text."""
    spoken = F.col("role").isin("user", "assistant")
    return turns.groupBy("session_id").agg(F.count_if(spoken).alias("message_count"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("ord"))).alias("first_text"))
