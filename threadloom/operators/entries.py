"""Dialect C: a session file's lines as tree entries, and entries as blocks.

Input: lines as sources.jsonl.lines gives them, (path, line_number, value, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import shape
from threadloom.functions.text import bound, trimmed

# Each tag's required fields besides id, parentId and timestamp, and their kinds.
FIELDS = {
    "message": {"message": "object"},
    "model_change": {"provider": "string", "modelId": "string"},
    "thinking_level_change": {"thinkingLevel": "string"},
    "compaction": {"summary": "string", "tokensBefore": "number"},
    "branch_summary": {"fromId": "string", "summary": "string"},
    "custom": {"customType": "string"},
    "custom_message": {"customType": "string", "content": "string|array", "display": "boolean"},
    "label": {"targetId": "string", "label": "string"},
    "session_info": {"name": "string"},
}
# What a field that may be absent must be if it is there.
OPTIONAL = {
    "compaction": {"retainedTail": "array", "firstKeptEntryId": "string", "usage": "object", "fromHook": "boolean"},
    "branch_summary": {"usage": "object", "fromHook": "boolean"},
}
# A message's required fields by role; all have a numeric timestamp.
ROLES = {
    "user": {"content": "string|array"},
    "assistant": {"content": "array", "api": "string", "provider": "string", "model": "string", "usage": "object", "stopReason": "string"},
    "toolResult": {"toolCallId": "string", "toolName": "string", "content": "array", "isError": "boolean"},
    "bashExecution": {"command": "string", "output": "string", "cancelled": "boolean", "truncated": "boolean"},
    "custom": {"customType": "string", "content": "string|array", "display": "boolean"},
    "branchSummary": {"summary": "string", "fromId": "string"},
    "compactionSummary": {"summary": "string", "tokensBefore": "number"},
}
# A message's fields that may be absent.
ROLE_OPTIONAL = {
    "assistant": {"errorMessage": "string"},
    "toolResult": {"usage": "object"},
    "bashExecution": {"exitCode": "number", "fullOutputPath": "string", "excludeFromContext": "boolean"},
}
# What an assistant's message can stop for, and what usage counts.
STOPS = ("stop", "length", "toolUse", "error", "aborted")
USAGE = {"input": "number", "output": "number", "cacheRead": "number", "cacheWrite": "number", "totalTokens": "number", "cost": "object"}
COST = {"input": "number", "output": "number", "cacheRead": "number", "cacheWrite": "number", "total": "number"}
# The items of contents, of what people and tools say, and of what an assistant says.
ITEMS = {"text": {"text": "string"}, "image": {"data": "string", "mimeType": "string"}}
OWN_ITEMS = {"text": {"text": "string"}, "thinking": {"thinking": "string"}, "toolCall": {"id": "string", "name": "string", "arguments": "object"}}
OWN_OPTIONAL = {"thinking": {"startedAt": "number", "endedAt": "number"}}
# The payload of each metadata tag.
PAYLOADS = {
    "model_change": ("provider", "modelId"),
    "thinking_level_change": ("thinkingLevel",),
    "compaction": ("summary", "tokensBefore"),
    "branch_summary": ("fromId", "summary"),
    "custom_message": ("content", "display", "details"),
    "label": ("targetId", "label"),
    "session_info": ("name",),
}
BASE = {"id": "string", "timestamp": "string", "parentId": "string|null"}
HEADER = {"version": "number", "id": "string", "timestamp": "string", "cwd": "string"}
#: Objects whose fields are told, of an entry and of a message.
OBJECTS, MESSAGE_OBJECTS = ("", "usage", "usage.cost"), ("", "usage", "usage.cost")


def _rules_of_entries() -> dict[str, shape.Rules]:
    used = {"usage": USAGE, "usage.cost": COST}
    own = {tag: shape.rules({"": BASE | named, **(used if "usage" in OPTIONAL.get(tag, {}) else {})}, {"": OPTIONAL.get(tag, {})}) for tag, named in FIELDS.items()}
    return own | {"session": shape.rules({"": HEADER}, {"": {"parentSession": "string"}})}


def _rules_of_messages() -> dict[str, shape.Rules]:
    used = {"usage": USAGE, "usage.cost": COST}
    spends = lambda role: "usage" in ROLES[role] or "usage" in ROLE_OPTIONAL.get(role, {})
    return {role: shape.rules({"": named | {"timestamp": "number"}, **(used if spends(role) else {})}, {"": ROLE_OPTIONAL.get(role, {})}) for role, named in ROLES.items()}


def _text(value: Column, path: str) -> Column:
    """The string at a path of a variant; null if it is anything else."""
    return bound(F.try_variant_get(value, path, "variant"), lambda x: F.when(shape.kind_of(x) == "string", F.try_variant_get(x, "$", "string")))


def _contents_fit(message: Column, own: Column) -> Column:
    """Whether the items of a list of contents are of known types with their fields; own: whether an assistant said it."""
    fit = lambda items: items.isNull() | F.when(own, shape.items_fit(items, OWN_ITEMS, OWN_OPTIONAL)).otherwise(shape.items_fit(items, ITEMS))
    return bound(F.try_variant_get(message, "$.content", "array<variant>"), fit)


def message_fits(message: Column) -> Column:
    """Whether a variant is a message of a known role, with its fields, items and usage."""

    def fits(role: Column) -> Column:
        wrong = shape.issues(shape.kinds(message, MESSAGE_OBJECTS), shape.lookup(_rules_of_messages(), role))
        listed = role.isin("user", "custom", "toolResult", "assistant")
        stops = (role != "assistant") | _text(message, "$.stopReason").isin(*STOPS)
        return (F.size(wrong) == 0) & stops & (~listed | _contents_fit(message, role == "assistant"))

    return F.coalesce(bound(_text(message, "$.role"), fits), F.lit(False))


def _entry(v: Column) -> Column:
    """struct(tag, id, parent_id, timestamp, issues, entry_kind) of a line's variant."""

    def told(tag: Column) -> Column:
        known = tag.isin("session", *FIELDS)
        own = F.when(known, shape.lookup(_rules_of_entries(), tag)).otherwise(shape.lookup({"": shape.rules({"": BASE})}, F.lit("")))
        message, tail = F.try_variant_get(v, "$.message", "variant"), F.try_variant_get(v, "$.retainedTail", "array<variant>")
        inner = F.when(tag == "message", bound(message, message_fits)).when(tag == "custom_message", _contents_fit(v, F.lit(False))).when(tag == "compaction", F.coalesce(F.forall(tail, message_fits), F.lit(True))).otherwise(True)
        kind = lambda issues: F.when(tag.isNull() | (F.size(issues) > 0) | ~inner, "invalid").when(known, "known").otherwise("unknown")
        issues = F.when(tag.isNotNull(), shape.issues(shape.kinds(v, OBJECTS), own))
        rest = lambda issues: F.struct(tag.alias("tag"), _text(v, "$.id").alias("id"), _text(v, "$.parentId").alias("parent_id"), _text(v, "$.timestamp").alias("timestamp"), issues.alias("issues"), kind(issues).alias("entry_kind"))
        return bound(issues, rest)

    return F.when(v.isNotNull(), bound(_text(v, "$.type"), told))


def parsed(lines: DataFrame) -> DataFrame:
    """lines with entry_kind (known, unknown, invalid; null if not JSON), tag, id, parent_id, timestamp, issues and a diagnostic.

    A tag that isn't known needs the base fields only and stays in the tree; a known one
    whose fields don't fit is invalid, and so is a message with an item, a usage or a reason
    to stop that isn't one, or a compaction that retains such a message. issues: code and
    path of the entry's own fields. diagnostic: invalid_json, invalid_entry, oversized_line or
    null; blank lines have none. A JSON object with a key twice is not JSON here.
    """
    rows = lines.withColumn("_e", bound(F.when(F.col("status") == "ok", F.try_parse_json("value")), _entry))
    wrong = F.when(F.col("status") == "oversized", "oversized_line").when((F.col("status") == "ok") & F.col("_e").isNull(), "invalid_json").when(F.col("_e.entry_kind") == "invalid", "invalid_entry")
    return rows.select(*lines.columns, "_e.*", wrong.alias("diagnostic"))


def files(entries: DataFrame) -> DataFrame:
    """(path, session_id, successful, terminal_malformed) of parsed lines: the first valid header's id, and whether the last line is a bad one."""
    bad = F.col("diagnostic").isin("invalid_json", "invalid_entry")
    header = (F.col("entry_kind") == "known") & (F.col("tag") == "session")
    told = entries.groupBy("path").agg(F.min_by(F.when(header, F.col("id")), F.when(header, F.col("line_number"))).alias("session_id"), F.max(F.when(bad, F.col("line_number"))).alias("_bad"), F.max("line_number").alias("_last"))
    return told.select("path", "session_id", (F.col("session_id").isNotNull() & F.col("_bad").isNull()).alias("successful"), F.coalesce(F.col("_bad") == F.col("_last"), F.lit(False)).alias("terminal_malformed"))


def blocks(entries: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_number, place, id, type, role, entry_id, parent_id, entry_type, content, payload, usage, is_error, custom_type).

    A message with several content items is a block for each, with its place in the id; with
    one or none it is one block. content is a JSON array; other entries are metadata with their payload as JSON.
    also: more columns of the entries.
    """
    at = lambda path: F.get_json_object("value", path)
    joins = F.col("entry_kind").isin("known", "unknown") & (F.col("tag") != "session")  # no filter: moved below the parsing, it would parse again
    m, role = F.col("tag") == "message", at("$.message.role")
    plain = F.when(role == "bashExecution", at("$.message.output")).when(role.isin("branchSummary", "compactionSummary"), at("$.message.summary")).otherwise(at("$.message.content"))
    listed = trimmed(at("$.message.content")).startswith("[") & F.try_variant_get(F.try_parse_json("value"), "$.message.content", "array<variant>").isNotNull()
    spoken = F.array(F.to_json(F.struct(F.lit("text").alias("type"), plain.alias("text"))))
    items = F.when(m, F.when(listed & role.isin("user", "custom", "assistant", "toolResult"), F.from_json(at("$.message.content"), "array<string>")).otherwise(spoken))
    rows = entries.withColumn("_items", items)
    split = F.when(joins, F.when(F.size("_items") > 1, F.transform("_items", lambda x: F.array(x))).otherwise(F.array("_items")))
    each = rows.select("*", F.posexplode(split).alias("place", "_own"))
    payload = F.when(F.col("entry_kind") == "unknown", trimmed(F.col("value"))).when(F.col("tag") == "custom", at("$.data"))
    v = F.try_parse_json("value")
    for name, fields in PAYLOADS.items():
        payload = payload.when(F.col("tag") == name, F.to_json(F.struct(*(F.try_variant_get(v, f"$.{f}", "variant").alias(f) for f in fields))))
    error = F.when(role == "toolResult", at("$.message.isError") == "true").when((role == "assistant") & at("$.message.errorMessage").isNotNull(), True)
    usage = F.when(m & role.isin("assistant", "toolResult"), at("$.message.usage")).when(F.col("tag").isin("compaction", "branch_summary"), at("$.usage"))
    return each.select(
        "path", "line_number", "place", F.when(F.size("_items") > 1, F.concat("id", F.lit(":"), F.col("place").cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(m, "message").otherwise("metadata").alias("type"), F.when(m, role).otherwise("metadata").alias("role"), F.col("id").alias("entry_id"), "parent_id", F.col("tag").alias("entry_type"),
        F.when(m, F.concat(F.lit("["), F.array_join("_own", ","), F.lit("]"))).alias("content"), payload.alias("payload"), usage.alias("usage"), F.when(m, error).alias("is_error"),
        F.when(F.col("tag").isin("custom", "custom_message"), at("$.customType")).alias("custom_type"), *also,
    )


def listing(entries: DataFrame, cwd: str | None = None) -> DataFrame:
    """(path, id, cwd, parent_session, message_count, first_message, name, error) of parsed lines, by path.

    The first line that isn't blank must be a valid header, else the file is listed with an
    error; so is one with a bad line after it. Files of another cwd are left out.
    """
    at = lambda path: F.get_json_object("value", path)
    said = F.filter(F.from_json(at("$.message.content"), "array<struct<type string, text string>>"), lambda x: x["type"] == "text")
    content = F.when(trimmed(at("$.message.content")).startswith("[") & said.isNotNull(), F.array_join(F.transform(said, lambda x: x["text"]), "\n")).otherwise(at("$.message.content"))
    first = F.row_number().over(Window.partitionBy("path").orderBy("line_number")) == 1
    rows = entries.filter("status <> 'blank'").withColumn("_first", first)
    m = (F.col("entry_kind") == "known") & (F.col("tag") == "message")
    head = F.col("_first") & (F.col("entry_kind") == "known") & (F.col("tag") == "session")
    user, named = m & (at("$.message.role") == "user"), (F.col("entry_kind") == "known") & (F.col("tag") == "session_info")
    out = rows.groupBy("path").agg(
        F.max(F.when(head, F.struct(F.col("id"), at("$.cwd").alias("cwd"), at("$.parentSession").alias("parent_session")))).alias("h"), F.count_if(m).alias("message_count"),
        F.min_by(F.when(user, content), F.when(user, F.col("line_number"))).alias("first_message"), F.max_by(F.when(named, at("$.name")), F.when(named, F.col("line_number"))).alias("name"),
        F.min(F.when(F.col("diagnostic").isNotNull(), F.struct("line_number", "diagnostic")))["diagnostic"].alias("_bad"),
    )
    error = F.when(F.col("h").isNull(), "invalid_session_header").otherwise(F.col("_bad"))
    out = out.withColumn("error", error).filter(F.col("h").isNull() | F.lit(cwd is None) | (F.col("h.cwd") == F.lit(cwd)))
    return out.select("path", "h.id", "h.cwd", "h.parent_session", "message_count", "first_message", "name", "error").orderBy("path")
