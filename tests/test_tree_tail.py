"""Dialect C's tail: folding the changes of a file that comes in pieces gives the active branch's blocks of the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_session_tail import rocks  # noqa: F401
from threadloom.operators import changes, entries, tree
from threadloom.sources import jsonl


def entry(id_, parent, k, rng, compaction=None):
    base = {"id": id_, "parentId": parent, "timestamp": f"t{k}"}
    if compaction is not None:
        return base | {"type": "compaction", "summary": "s", "tokensBefore": 1, **compaction}
    items = [{"type": "text", "text": f"é {k}"}] * rng.randrange(4)
    return rng.choice([base | {"type": "message", "message": {"role": "user", "content": items, "timestamp": k}}, base | {"type": "message", "message": {"role": "user", "content": f"plain {k}", "timestamp": k}}, base | {"type": "label", "targetId": "e0", "label": "x"}, base | {"type": "odd"}])


def tree_file(rng, n):
    """Lines of a session: long chains, some branches, compactions of both kinds, duplicates, orphans and other lines."""
    out, ids = [json.dumps({"type": "session", "version": 3, "id": "S", "timestamp": "t", "cwd": "/"})], []
    for k in range(n):
        parent = None if not ids else rng.choice(ids) if rng.random() < 0.15 else ids[-1]
        kind = rng.random()
        if kind < 0.05:
            out.append(rng.choice(["{torn", "", json.dumps({"type": "message", "id": 5})]))
        elif kind < 0.1:
            out.append(json.dumps(entry(rng.choice(ids or ["x"]), parent, k, rng)))
            ids = ids or ["x"]
        elif kind < 0.15:
            out.append(json.dumps(entry(f"orphan{k}", "nowhere", k, rng)))
        else:
            tail = [{"role": "user", "content": f"kept {k} {i}", "timestamp": k} for i in range(rng.randrange(3))]
            compaction = None if kind < 0.9 or not ids else rng.choice([{"retainedTail": tail}, {"firstKeptEntryId": rng.choice(ids)}, {}])
            out.append(json.dumps(entry(f"e{k}", parent, k, rng, compaction)))
            ids.append(f"e{k}")
    return ("\n".join(out) + "\n").encode()


def folded(rows):
    """(path, id) in the order of first upserts since the last delete, with the last content."""
    out = {}
    for r in rows:
        own = out.setdefault(r["path"], {})
        if r["op"] == "delete":
            own.pop(r["id"], None)
        else:
            own[r["id"]] = (r["content"], r["payload"], r["type"])
    return {p.rsplit("/", 1)[1]: list(own.items()) for p, own in out.items()}


def whole(spark, logs):
    """The same by the batch operators."""
    lines = entries.parsed(jsonl.lines(jsonl.files(spark, str(logs))))
    valid = lines.filter("entry_kind in ('known', 'unknown') and tag <> 'session'").withColumns({"session_id": F.col("path"), "ord": F.col("line_number"), "type": F.col("tag"), "first_kept_id": F.get_json_object("value", "$.firstKeptEntryId"), "retained": F.from_json(F.get_json_object("value", "$.retainedTail"), "array<string>")})
    ok = tree.accepted(valid).cache()
    branch = tree.compacted(ok)
    made = entries.blocks(ok, ("ord",)).select("path", F.col("entry_id").alias("key"), "place", "id", "content", "payload", "type")
    tails = ok.filter("type = 'compaction'").select("path", F.col("id").alias("c"), "timestamp", F.posexplode("retained").alias("n", "m"))
    key = F.concat(F.lit("retained:"), "c", F.lit(":"), F.col("n").cast("string"))
    kept = tails.select("path", F.lit(0).alias("line_number"), F.lit("ok").alias("status"), F.concat(F.lit('{"type":"message","parentId":null,"timestamp":"t","id":"'), key, F.lit('","message":'), "m", F.lit("}")).alias("value"))
    made = made.unionByName(entries.blocks(entries.parsed(kept)).select("path", F.col("entry_id").alias("key"), "place", "id", "content", "payload", "type"))
    rows = branch.withColumnRenamed("place", "at").withColumnRenamed("session_id", "path").join(made, ["path", "key"]).orderBy("path", "at", "place").collect()
    out = {}
    for r in rows:
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["id"], (r["content"], r["payload"], r["type"])))
    return out


def test_random_trees_cut_at_random_places(spark, rocks, tmp_path):  # noqa: F811
    from threadloom.streaming.tail import follow
    from threadloom.streaming.tree_tail import tail_tree_blocks

    rng = random.Random(5)
    logs = tmp_path / "logs"
    logs.mkdir()
    files = {logs / f"s{i}.jsonl": tree_file(rng, rng.randrange(5, 60)) for i in range(40)}
    cuts = {f: [0, *sorted(rng.choices(range(len(data)), k=3)), len(data)] for f, data in files.items()}
    for k in range(4):
        for f, data in files.items():
            with f.open("ab") as out:
                out.write(data[cuts[f][k] : cuts[f][k + 1]])
        tail_tree_blocks(follow(spark, str(logs))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("path", "change_ord", "place").collect()
    assert folded(got) == whole(spark, logs)
    ops = [r["op"] for r in got]
    assert ops.count("delete") > 50 and ops.count("upsert") > 400


@pytest.mark.parametrize(("old", "new"), [("abcd", "abxyz"), ("ab", "abc"), ("abc", "a"), ("ab", "ab"), ("", "ab"), ("ab", ""), ("abc", "bca")])
def test_a_splice_as_changes_of_blocks(spark, old, new):
    table = lambda keys: spark.createDataFrame([("s", i, k) for i, k in enumerate(keys)], "session_id string, place int, key string")
    parts = {k: 1 + (k in "bx") for k in set(old + new)}
    blocks = spark.createDataFrame([("s", k, n, f"{k}{n}") for k, count in parts.items() for n in range(count)], "session_id string, key string, part int, id string")
    got = changes.block_changes(table(old), table(new), blocks).orderBy("change_ord").collect()
    now = dict.fromkeys(f"{k}{n}" for k in old for n in range(parts[k]))
    for r in got:
        now.pop(r["id"]) if r["op"] == "delete" else now.setdefault(r["id"])
    assert list(now) == [f"{k}{n}" for k in new for n in range(parts[k])]
    assert [r["change_ord"] for r in got] == list(range(1, len(got) + 1)) and (old != new or not got)
