"""Dialect C's tail: a session tree that grows, as deletes and upserts of the active branch's blocks.

The state, a key for each session file, is the graph (an entry's parent and line by id),
the path from the root to the leaf, and how many changes there were. Entries that continue
the leaf, without a compaction, are a pure append: their blocks are upserts, and nothing
else is looked at. Else the path is walked again from the new leaf, and the splice that
turns the old projection into the new becomes deletes of what went and upserts of what came,
in order. Folding the changes gives the blocks of ``operators.tree.compacted`` over the whole
file: a later upsert of an id takes the place of the earlier.

Entries are taken as they come: one whose parent isn't known yet, or whose id is, is left
out, as in ``tree.accepted``; ids that come again after a cycle of their own count there as
cycles, and here as new. A greater generation of a file deletes all and starts anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators.entries import blocks, parsed

SPLICES = "path string, generation long, line_number long, change_ord long, op string, key string, value string, status string"


def projection(path: list[dict]) -> list[str]:
    """The keys of the active branch, of a path's entries (id, compaction: null, or what it keeps) from the root on."""
    last = max((k for k, e in enumerate(path) if e["compaction"] is not None), default=None)
    if last is None:
        return [e["id"] for e in path]
    own = path[last]
    if own["compaction"]["retained"] is not None:
        kept = [f"retained:{own['id']}:{n}" for n in range(own["compaction"]["retained"])]
    else:
        first = next((k for k, e in enumerate(path[:last]) if e["id"] == own["compaction"]["first"]), last)
        kept = [e["id"] for e in path[first:last] if e["compaction"] is None]
    return [own["id"], *kept, *(e["id"] for e in path[last + 1 :])]


class Trees(StatefulProcessor):
    """Keeps a file's graph and path, and emits what goes from its projection and what comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "generation long, changes long, lines long, leaf string")
        self.entries = handle.getMapState("entries", "id string", "parent string, compaction string, value string")
        self.keys = handle.getListState("keys", "key string")

    def entry(self, id_: str) -> dict:
        parent, compaction, value = self.entries.getValue((id_,))
        return {"id": id_, "parent": parent, "compaction": None if compaction is None else json.loads(compaction), "value": value}

    def line(self, key: str) -> str:
        """The entry of a key as a line; a retained message is a message entry of its own."""
        if not key.startswith("retained:") or self.entries.containsKey((key,)):
            return self.entry(key)["value"]
        compaction, n = key.removeprefix("retained:").rsplit(":", 1)
        own = json.loads(self.entry(compaction)["value"])
        return json.dumps({"type": "message", "id": key, "parentId": compaction, "timestamp": own["timestamp"], "message": own["retainedTail"][int(n)]}, ensure_ascii=False)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        generation, changes, lines, leaf = self.at.get() if self.at.exists() else (0, 0, 0, None)
        rows = sorted(rows, key=lambda r: (r.generation, r.byte_start))
        done = 0
        while done < len(rows):
            old = None  # the projection before, once it is needed
            if rows[done].generation > generation:
                changes = yield from self.told(key[0], generation, lines, changes, "delete", [(k, self.line(k)) for (k,) in self.keys.get()])
                generation, lines, leaf = rows[done].generation, 0, None
                self.entries.clear()
                self.keys.clear()
            appended: list[str] = []
            while done < len(rows) and rows[done].generation == generation:
                r, done, lines = rows[done], done + 1, lines + 1
                if not r.id or self.entries.containsKey((r.id,)) or (r.parent_id is not None and not self.entries.containsKey((r.parent_id,))):
                    continue
                self.entries.updateValue((r.id,), (r.parent_id, r.compaction, r.value))
                if old is None and (r.parent_id != leaf or r.compaction is not None):
                    old = [k for (k,) in self.keys.get()]
                appended.append(r.id)
                leaf = r.id
            if old is None:  # a pure append
                if appended:
                    self.keys.appendList([(k,) for k in appended])
                changes = yield from self.told(key[0], generation, lines, changes, "upsert", [(k, self.line(k)) for k in appended])
                continue
            path = [self.entry(leaf)]
            while path[-1]["parent"] is not None:
                path.append(self.entry(path[-1]["parent"]))
            new = projection(path[::-1])
            same = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
            self.keys.put([(k,) for k in new])
            changes = yield from self.told(key[0], generation, lines, changes, "delete", [(k, self.line(k)) for k in old[same:]])
            changes = yield from self.told(key[0], generation, lines, changes, "upsert", [(k, self.line(k)) for k in new[same:]])
        self.at.update((generation, changes, lines, leaf))

    def told(self, path: str, generation: int, lines: int, changes: int, op: str, found: list[tuple[str, str]]) -> Iterator[Row]:
        for key, value in found:
            changes += 1
            yield Row(path=path, generation=generation, line_number=lines, change_ord=changes, op=op, key=key, value=value, status="ok")
        return changes

    def close(self) -> None:
        """Nothing is held besides the state."""


def splices(lines: DataFrame) -> DataFrame:
    """(path, generation, line_number, change_ord, op, key, value, status): the entries that go and come, of the stream of ``tail.follow``.

    line_number is the last line of the batch.
    """
    valid = parsed(lines).filter(F.col("entry_kind").isin("known", "unknown") & (F.col("tag") != "session"))
    at = lambda path: F.get_json_object("value", path)
    retained = F.json_array_length(at("$.retainedTail"))
    kept = F.to_json(F.struct(at("$.firstKeptEntryId").alias("first"), retained.alias("retained")), {"ignoreNullFields": "false"})
    slim = valid.select("path", "generation", "byte_start", "id", "parent_id", F.when(F.col("tag") == "compaction", kept).alias("compaction"), "value")
    return slim.groupBy("path").transformWithState(statefulProcessor=Trees(), outputStructType=SPLICES, outputMode="Append", timeMode="None")


def tail_tree_blocks(lines: DataFrame) -> DataFrame:
    """The blocks' changes that new lines bring: ``entries.blocks`` with op, change_ord and generation.

    (change_ord, place) is the order of a file's changes; deletes name their block by its id.
    """
    return blocks(parsed(splices(lines)), ("generation", "change_ord", "op", "key"))
