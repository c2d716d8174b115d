"""Dialect B's tail: folding the changes of a log that comes in pieces gives the blocks of the whole."""

import json
import random

from pyspark.sql import functions as F

from tests.test_session_tail import rocks  # noqa: F401
from tests.test_sessions import updates_of
from threadloom.operators import history, updates

ROW = "session_id string, generation long, source_id string, ord long, byte_start long, timestamp double, u string, meta_prompt_id string"
COLUMNS = ("type", "timestamp", "content", "tool_use_id", "title", "kind", "status", "input", "output", "subagent_id", "child_session_id", "direction", "is_error")


def more_updates(rng, n, rewinds):
    """Also subagents, inputs and outputs."""
    rows = updates_of(rng, n, rewinds)
    for k, (at, u) in enumerate(rows):
        if u["sessionUpdate"].startswith("tool_call"):
            u |= {**({"rawInput": {"n": k}} if rng.random() < 0.3 else {}), **({"rawOutput": f"out {k}"} if rng.random() < 0.5 else {"content": [k]})}
        if rng.random() < 0.08:
            rows[k] = (at, {"sessionUpdate": rng.choice(["subagent_spawned", "subagent_finished"]), "subagent_id": rng.choice("ab"), "child_session_id": "c", "status": "ok"})
    return rows


def changes_of(spark, tmp_path, batches):
    from threadloom.streaming.updates_tail import tail_changes

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in/*"))
        tail_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_random_logs_cut_at_random_places(spark, rocks, tmp_path):  # noqa: F811
    rng = random.Random(9)
    logs = {f"S{i}": more_updates(rng, 60, i % 7) for i in range(500)}
    batches = [[], [], []]
    for s, rows in logs.items():
        cuts = [0, *sorted(rng.choices(range(61), k=2)), 60]
        for k in range(3):
            batches[k] += [(s, 0, "u", at, start, float(at), json.dumps(u), None) for at, (start, u) in list(enumerate(rows))[cuts[k] : cuts[k + 1]]]
    got = changes_of(spark, tmp_path, batches)
    assert got.filter("op = 'delete'").count() > 300
    folded = history.fold_changes(got, ["session_id", "id"], "change_ord")
    whole = updates.blocks(spark.createDataFrame(sum(batches, []), ROW))
    rows = lambda df: {(r["session_id"], r["id"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert rows(folded) == rows(whole)
    # only blocks that a batch writes or removes come in it
    written = {r["session_id"]: r["n"] for r in got.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n <= 61 * 2 for n in written.values())


def test_a_new_generation_deletes_all(spark, rocks, tmp_path):  # noqa: F811
    say = lambda text: json.dumps({"sessionUpdate": "agent_message_chunk", "content": {"type": "text", "text": text}})
    got = changes_of(spark, tmp_path, [[("S", 0, "u", 0, 0, 0.0, say("a"), "p"), ("S", 0, "u", 1, 5, 1.0, say("b"), None)], [("S", 1, "u", 0, 0, 2.0, say("c"), "p")]])
    assert [(r["op"], r["id"], r["content"]) for r in got.orderBy("change_ord").collect()] == [("upsert", "S:assistant_text:p:stream-0", "a"), ("upsert", "S:assistant_text:unscoped:stream-5", "b"), ("delete", "S:assistant_text:p:stream-0", "a"), ("delete", "S:assistant_text:unscoped:stream-5", "b"), ("upsert", "S:assistant_text:p:stream-0", "c")]


def test_from_files(spark, rocks, tmp_path):  # noqa: F811
    from threadloom.streaming.tail import follow
    from threadloom.streaming.updates_tail import tail_changes
    from threadloom.streaming.updates_tail import updates_of as of_lines

    logs = tmp_path / "logs"
    logs.mkdir()
    envelope = lambda k, u: json.dumps({"timestamp": k, "method": "session/update", "params": {"sessionId": "S", "update": u}}) + "\n"
    chunk = lambda t: {"sessionUpdate": "user_message_chunk", "content": {"type": "text", "text": t}, "_meta": {"promptIndex": 1}}

    def run():
        tail_changes(of_lines(follow(spark, str(logs)))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [(r["op"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("change_ord").collect()]

    (logs / "updates.jsonl").write_text(envelope(1, chunk("one ")) + "{torn\n")
    run()
    with (logs / "updates.jsonl").open("a") as f:
        f.write(envelope(2, chunk("two")) + envelope(3, {"sessionUpdate": "rewind_marker", "target_prompt_index": 0}))
    assert run() == [("upsert", "one "), ("delete", "one two")]
