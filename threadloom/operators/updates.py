"""Dialect B: streams of updates and events, reduced to blocks and activities by windows and aggregates.

Rows carry (session_id, source_id, ord, byte_start, timestamp, u) with u the update's JSON
text; ord is the merge order of the session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import epoch_ms
from threadloom.operators.changes import joined

# The chunk tags and the type of block that each adds to.
CHUNKS = {"user_message_chunk": "user_text", "agent_message_chunk": "assistant_text", "agent_thought_chunk": "thinking"}
METHODS = ("session/update", "_x.ai/session/update")


def get(u: Column, path: str) -> Column:
    return F.get_json_object(u, f"$.{path}")


def parse_envelopes(lines: DataFrame) -> DataFrame:
    """lines (…, value) with session_id, u, timestamp in ms and a status: known, unknown (kept too) or invalid."""
    j = F.col("value")
    tag = get(j, "params.update.sessionUpdate")
    at = F.coalesce(get(j, "params._meta.agentTimestampMs").try_cast("double"), epoch_ms(get(j, "timestamp").try_cast("double")))
    status = F.when(F.try_parse_json(j).isNull() | get(j, "params.sessionId").isNull() | tag.isNull() | at.isNull(), "invalid").when(~get(j, "method").isin(*METHODS), "unknown").otherwise("known")
    return lines.withColumns({"status": status, "session_id": get(j, "params.sessionId"), "timestamp": at, "u": get(j, "params.update"), "meta_prompt_id": get(j, "params._meta.promptId")})


def merge_order(updates: DataFrame, events: DataFrame) -> DataFrame:
    """Both sources in one order: time, updates first, place in the file."""
    both = updates.withColumn("source_kind", F.lit(0)).unionByName(events.withColumn("source_kind", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "source_kind", "byte_start")))


def _upto(order: str = "ord") -> Window:
    return Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def upserts(rows: DataFrame) -> DataFrame:
    """One row for each time a block is written: its id, type, prompt index and the fields that the update sets."""
    u, tag = F.col("u"), F.col("tag")
    own_prompt = get(u, "_meta.promptIndex").try_cast("long")
    said = tag.isin(*CHUNKS) & (get(u, "content.type") == "text")
    kind = F.create_map(*(F.lit(x) for pair in CHUNKS.items() for x in pair))[tag]
    sets = F.when((tag == "user_message_chunk") & said, own_prompt).when(tag == "rewind_marker", get(u, "target_prompt_index").try_cast("long"))
    all_end = tag.isin("turn_completed", "rewind_marker")
    base = rows.withColumn("tag", get(u, "sessionUpdate"))
    base = base.withColumns({
        "now": F.last(sets, ignorenulls=True).over(_upto()),
        "user_epoch": F.sum(all_end.cast("int")).over(_upto()),
        "own_epoch": F.sum((all_end | (tag == "tool_call")).cast("int")).over(_upto()),
    })
    chunks = base.filter(said).withColumns({"type": kind, "prompt": F.coalesce(own_prompt, F.col("now")), "explicit": get(u, "messageId")})
    chunks = chunks.withColumn("corr", F.coalesce(get(u, "_meta.promptId"), F.col("meta_prompt_id"), F.concat(F.lit("prompt-"), F.col("prompt").cast("string")), F.lit("unscoped")))
    epoch = F.when(F.col("type") == "user_text", F.col("user_epoch")).otherwise(F.col("own_epoch"))
    stream = Window.partitionBy("session_id", "type", "corr", epoch)
    first = F.min(F.when(F.col("explicit").isNull(), F.struct("ord", "byte_start"))).over(stream)["byte_start"]
    message = F.coalesce("explicit", F.concat(F.col("corr"), F.lit(":stream-"), first.cast("string")))
    common = ("session_id", "ord", "timestamp")
    none = lambda kind="string": F.lit(None).cast(kind)

    def row(df: DataFrame, id_: Column, type_: Column, prompt: Column, creates: Column, **fields: Column) -> DataFrame:
        names = ("text", "tool_use_id", "title", "kind", "status", "input", "output", "subagent_id", "child_session_id", "direction")
        return df.select(*common, F.concat_ws(":", F.col("session_id"), id_).alias("id"), type_.alias("type"), prompt.alias("prompt"), creates.alias("creates"), *(fields.get(n, none()).alias(n) for n in names))

    out = row(chunks, F.concat_ws(":", F.col("type"), message), F.col("type"), F.col("prompt"), F.lit(True), text=get(u, "content.text"))
    call = get(u, "toolCallId")
    tools = base.filter(tag.isin("tool_call", "tool_call_update"))
    sets_use = (tag == "tool_call") | F.coalesce(get(u, "title"), get(u, "kind"), get(u, "status")).isNotNull() | F.array_contains(F.json_object_keys(u), "rawInput")
    use = row(tools.filter(sets_use), F.concat_ws(":", F.lit("tool_use"), call), F.lit("tool_use"), F.col("now"), tag == "tool_call", tool_use_id=call, title=get(u, "title"), kind=get(u, "kind"), status=get(u, "status"), input=get(u, "rawInput"))
    done = tools.filter((tag == "tool_call_update") & get(u, "status").isin("completed", "failed"))
    output = F.when(F.array_contains(F.json_object_keys(u), "rawOutput"), get(u, "rawOutput")).otherwise(get(u, "content"))
    result = row(done, F.concat_ws(":", F.lit("tool_result"), call), F.lit("tool_result"), F.col("now"), F.lit(True), tool_use_id=call, status=get(u, "status"), output=output)
    way = F.when(tag == "subagent_spawned", "enter").otherwise("exit")
    bounds = row(base.filter(tag.isin("subagent_spawned", "subagent_finished")), F.concat_ws(":", F.lit("agent_boundary"), get(u, "subagent_id"), way), F.lit("agent_boundary"), F.col("now"), F.lit(True), subagent_id=get(u, "subagent_id"), child_session_id=get(u, "child_session_id"), direction=way, status=get(u, "status"))
    return out.unionAll(use).unionAll(result).unionAll(bounds)


def _lasting(session: pa.Table) -> pa.Table:
    """A session's writes (target null) and rewinds in order; which writes are of a block that no later rewind removes."""
    session = session.sort_by("ord")
    of_prompt: dict[int, set] = {}
    prompt_of: dict[str, int | None] = {}
    writes: dict[str, list[int]] = {}
    rows = zip(*(session.column(c).to_pylist() for c in ("id", "creates", "prompt", "target")), strict=True)
    for at, (id_, creates, prompt, target) in enumerate(rows):
        if target is None and id_ is not None:
            if creates or id_ not in prompt_of:
                if prompt_of.get(id_) is not None:
                    of_prompt[prompt_of[id_]].discard(id_)
                prompt_of[id_] = prompt
                if prompt is not None:
                    of_prompt.setdefault(prompt, set()).add(id_)
            writes.setdefault(id_, []).append(at)
        elif target is not None:
            for later in [p for p in of_prompt if p > target]:
                for gone in of_prompt.pop(later):
                    del prompt_of[gone], writes[gone]
    left = np.array(sorted(at for own in writes.values() for at in own), np.int64)
    return session.select(["session_id", "id", "ord"]).take(pa.array(left))


def lasting(writes: DataFrame, rewinds: DataFrame) -> DataFrame:
    """The writes of blocks as they are after all rewinds (session_id, ord, target).

    A rewind removes blocks whose prompt index is greater than its target; an update of a
    tool call keeps the index of the write that created the block, so what a rewind removes
    depends on the rewinds before it. Sessions with rewinds are gone through in order, each
    in one task, by ids alone; their texts stay where they are.
    """
    rewound = rewinds.select("session_id").distinct()
    slim = writes.join(rewound, "session_id", "left_semi").select("session_id", "id", "ord", "creates", F.col("prompt").cast("long").alias("prompt"), F.lit(None).cast("long").alias("target"))
    marks = rewinds.select("session_id", F.lit(None).cast("string").alias("id"), "ord", F.lit(None).cast("boolean").alias("creates"), F.lit(None).cast("long").alias("prompt"), "target")
    left = slim.unionByName(marks.filter("target is not null")).groupBy("session_id").applyInArrow(_lasting, T.StructType([slim.schema[c] for c in ("session_id", "id", "ord")]))
    return writes.join(rewound, "session_id", "left_anti").unionByName(writes.join(left, ["session_id", "id", "ord"], "left_semi").select(writes.columns))


def blocks(rows: DataFrame) -> DataFrame:
    """The blocks that are left after all updates, with text chunks joined and the last value of each field."""
    u = F.col("u")
    rewinds = rows.filter(get(u, "sessionUpdate") == "rewind_marker").select("session_id", "ord", get(u, "target_prompt_index").try_cast("long").alias("target"))
    alive = lasting(upserts(rows), rewinds)
    last = Window.partitionBy("session_id", "id")
    said = F.col("type").isin(*CHUNKS.values())
    whole = F.max(F.when(F.col("creates"), F.col("ord"))).over(last)  # a write of the whole block: nothing older counts
    alive = alive.withColumn("_whole", whole).filter(said | F.col("_whole").isNull() | (F.col("ord") >= F.col("_whole")))
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    fields = ("tool_use_id", "title", "kind", "status", "input", "output", "subagent_id", "child_session_id", "direction")
    out = alive.groupBy("session_id", "id").agg(F.first("type").alias("type"), F.max_by("timestamp", "ord").alias("timestamp"), F.min("ord").alias("first_ord"), joined("text", "ord").alias("content"), *map(value, fields))
    return out.withColumns({"content": F.when(said, F.col("content")), "title": F.when(F.col("type") == "tool_use", F.coalesce("title", "tool_use_id")), "is_error": F.when(F.col("type") == "tool_result", F.col("status") == "failed")})


def category(kind: Column) -> Column:
    return (
        F.when(kind.isin("turn_started", "turn_ended", "loop_started", "first_token", "interjected"), "turn")
        .when(kind == "phase_changed", "phase")
        .when(kind.startswith("permission_"), "permission")
        .when(kind.startswith("tool_") | kind.startswith("mcp_tool_call_"), "tool")
        .otherwise("lifecycle")
    )


def activities(events: DataFrame) -> DataFrame:
    """The latest state of each (category, correlation) of a session; events: (session_id, source_id, ord, timestamp, e JSON).

    Turns and phases belong to the last turn that started; its correlation is session:turn:number.
    """
    e = F.col("e")
    kind = get(e, "type")
    turn = F.last(F.when(kind == "turn_started", F.concat_ws(":", get(e, "session_id"), F.lit("turn"), get(e, "turn_number"))), ignorenulls=True).over(_upto())
    kept = events.withColumn("category", category(kind)).withColumn("_turn", F.coalesce(turn, F.col("source_id")))
    of = F.col("category")
    corr = (
        F.when(of.isin("turn", "phase"), F.col("_turn"))
        .when(of == "tool", F.coalesce(get(e, "tool_call_id"), get(e, "call_id"), get(e, "tool_name"), F.col("source_id")))
        .when(of == "permission", F.coalesce(get(e, "tool_name"), F.col("source_id")))
        .otherwise(kind)
    )
    state = F.coalesce(get(e, "phase"), get(e, "outcome"), get(e, "decision"), kind)
    last = kept.withColumns({"correlation_id": corr, "state": state}).groupBy("session_id", "category", "correlation_id")
    out = last.agg(F.max_by("state", "ord").alias("state"), F.max_by("timestamp", "ord").alias("timestamp"), F.max_by("source_id", "ord").alias("source_id"))
    return out.withColumn("id", F.concat_ws(":", F.col("source_id"), F.lit("activity"), F.col("category"), F.col("correlation_id")))
