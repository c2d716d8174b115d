"""Dialect B's tail: an incremental reduction that emits what changes, an upsert or a delete a block.

The state, a key for each session, is what a later update can still depend on: the prompt
index, the streams that are open, and the blocks as they are. A rewind retracts the blocks
of later prompts as deletes. Each batch emits, for a block that it wrote, the block as it
is after the batch; blocks that a batch both writes and removes come as a delete. Folding
all changes gives what ``operators.updates.blocks`` makes of the whole log.

Updates are taken in the order of arrival, within a batch by ``ord``. A greater
``generation`` of a session's file deletes all its blocks and starts anew. A session's
updates of one batch are one task's. The state needs Spark's RocksDB store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators.updates import CHUNKS, get

FIELDS = ("tool_use_id", "title", "kind", "status", "input", "output", "subagent_id", "child_session_id", "direction")
CHANGE = "session_id string, change_ord long, op string, id string, type string, prompt long, timestamp double, ord long, content string, " + ", ".join(f"{f} string" for f in FIELDS)


def steps(rows: DataFrame) -> DataFrame:
    """What an update does, as columns: rows (session_id, generation, ord, byte_start, timestamp, u, meta_prompt_id)."""
    u = F.col("u")
    tag = get(u, "sessionUpdate")
    update, keys = tag == "tool_call_update", F.json_object_keys(u)
    text = tag.isin(*CHUNKS) & (get(u, "content.type") == "text")
    bound = tag.isin("subagent_spawned", "subagent_finished")
    action = F.when(text, "text").when(tag.isin("tool_call", "tool_call_update"), tag).when(bound, "boundary").when(tag.isin("turn_completed", "rewind_marker"), tag)
    done = update & get(u, "status").isin("completed", "failed")
    kind_of = F.create_map(*(F.lit(x) for pair in CHUNKS.items() for x in pair))
    return rows.select(
        "session_id", "generation", "ord", "byte_start", "timestamp", action.alias("action"), F.when(text, kind_of[tag]).alias("type"), F.when(text, get(u, "content.text")).alias("text"),
        get(u, "_meta.promptIndex").try_cast("long").alias("prompt"), F.coalesce(get(u, "_meta.promptId"), F.col("meta_prompt_id")).alias("prompt_id"), get(u, "messageId").alias("message"), get(u, "target_prompt_index").try_cast("long").alias("target"),
        get(u, "toolCallId").alias("tool_use_id"), get(u, "title").alias("title"), get(u, "kind").alias("kind"), get(u, "status").alias("status"), get(u, "rawInput").alias("input"), F.array_contains(keys, "rawInput").alias("has_input"),
        F.when(done, F.when(F.array_contains(keys, "rawOutput"), get(u, "rawOutput")).otherwise(get(u, "content"))).alias("output"), F.coalesce(done, F.lit(False)).alias("done"),
        get(u, "subagent_id").alias("subagent_id"), get(u, "child_session_id").alias("child_session_id"), F.when(tag == "subagent_spawned", "enter").when(bound, "exit").alias("direction"),
    ).filter("action is not null")


class Blocks:
    """A session's blocks in a batch: those touched are read from the state once, and written back at the end."""

    def __init__(self, state):
        self.state, self.now, self.gone = state, {}, {}

    def get(self, id_: str) -> dict | None:
        if id_ not in self.now and id_ not in self.gone and self.state.containsKey((id_,)):
            return json.loads(self.state.getValue((id_,))[0])
        return self.now.get(id_)

    def put(self, id_: str, block: dict) -> None:
        self.now[id_] = block

    def remove(self, beyond: int | None) -> None:
        """Blocks of later prompts; all if beyond is None."""
        stored = {id_: json.loads(text) for (id_,), (text,) in self.state.iterator() if id_ not in self.gone}
        for id_, block in (stored | self.now).items():
            if beyond is None or (block["prompt"] is not None and block["prompt"] > beyond):
                self.gone[id_] = block
                self.now.pop(id_, None)

    def save(self) -> None:
        for id_ in self.gone:
            if self.state.containsKey((id_,)):
                self.state.removeKey((id_,))
        for id_, block in self.now.items():
            self.state.updateValue((id_,), (json.dumps(block),))


class Sessions(StatefulProcessor):
    """Goes through the steps of a session, and emits its blocks' changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "generation long, changes long, prompt long, streams string")
        self.blocks = handle.getMapState("blocks", "id string", "block string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        generation, changes, prompt, streams = self.at.get() if self.at.exists() else (0, 0, None, "{}")
        prompt, streams, blocks = prompt, json.loads(streams), Blocks(self.blocks)
        for r in sorted(rows, key=lambda r: (r.generation, r.ord)):
            if r.generation > generation:
                generation, prompt, streams = r.generation, None, {}
                blocks.remove(None)
            if r.action == "text":
                if r.type == "user_text" and r.prompt is not None:
                    prompt = r.prompt
                own = prompt if r.prompt is None else r.prompt
                corr = r.prompt_id or ("unscoped" if own is None else f"prompt-{own}")
                message = r.message if r.message is not None else streams.setdefault(f"{r.type}:{corr}", f"{corr}:stream-{r.byte_start}")
                self.write(blocks, r, f"{r.type}:{message}", r.type, own, content=r.text)
            elif r.action == "rewind_marker":
                streams, prompt = {}, r.target
                blocks.remove(r.target)
            elif r.action == "turn_completed":
                streams = {}
            elif r.action == "boundary":
                self.write(blocks, r, f"agent_boundary:{r.subagent_id}:{r.direction}", "agent_boundary", prompt, True, subagent_id=r.subagent_id, child_session_id=r.child_session_id, direction=r.direction, status=r.status)
            else:
                call = r.action == "tool_call"
                if call:
                    streams = {k: v for k, v in streams.items() if k.startswith("user_text:")}
                if call or r.title is not None or r.kind is not None or r.status is not None or r.has_input:
                    self.write(blocks, r, f"tool_use:{r.tool_use_id}", "tool_use", prompt, call, tool_use_id=r.tool_use_id, title=r.title, kind=r.kind, status=r.status, input=r.input)
                if r.done:
                    self.write(blocks, r, f"tool_result:{r.tool_use_id}", "tool_result", prompt, True, tool_use_id=r.tool_use_id, status=r.status, output=r.output)
        for op, found in (("delete", blocks.gone), ("upsert", blocks.now)):
            for id_, block in sorted(found.items(), key=lambda x: (x[1]["first"], x[0])):
                changes += 1
                yield Row(session_id=key[0], change_ord=changes, op=op, id=id_, **{c: block.get(c) for c in ("type", "prompt", "timestamp", "ord", "content", *FIELDS)})
        blocks.save()
        self.at.update((generation, changes, prompt, json.dumps(streams)))

    def write(self, blocks: Blocks, r: Row, name: str, block_type: str, prompt: int | None, whole: bool = False, content: str | None = None, **fields: str | None) -> None:
        """whole: nothing older of the block counts but its place; else texts are appended, and fields that are sent are set."""
        id_ = f"{r.session_id}:{name}"
        old = blocks.get(id_) or {"first": r.ord, "prompt": prompt}
        kept = {"first": old["first"]} if whole else dict(old)
        if whole or block_type != "tool_use":
            kept["prompt"] = prompt
        if content is not None:
            kept["content"] = kept.get("content", "") + content
        blocks.put(id_, kept | {k: v for k, v in fields.items() if v is not None} | {"type": block_type, "timestamp": r.timestamp, "ord": r.ord})

    def close(self) -> None:
        """Nothing is held besides the state."""


def tail_changes(rows: DataFrame) -> DataFrame:
    """The changes of blocks that new updates bring, of a stream with the columns of ``steps``.

    change_ord counts a session's changes: ``history.fold_changes`` by (session_id, id) in its
    order gives the blocks, with titles and errors as ``updates.blocks`` tells them.
    """
    out = steps(rows).groupBy("session_id").transformWithState(statefulProcessor=Sessions(), outputStructType=CHANGE, outputMode="Append", timeMode="None")
    return out.withColumns({"title": F.when(F.col("type") == "tool_use", F.coalesce("title", "tool_use_id")), "is_error": F.when(F.col("type") == "tool_result", F.col("status") == "failed")})


def updates_of(lines: DataFrame) -> DataFrame:
    """The valid updates in the stream of ``tail.follow``, for ``tail_changes``: ord is the place in the file."""
    from threadloom.operators.updates import parse_envelopes

    parsed = parse_envelopes(lines.filter("status = 'ok'")).filter("status = 'known'")
    return parsed.withColumn("ord", F.col("byte_start"))
