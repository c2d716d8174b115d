"""Session files end to end: lines, history, blocks, updates, trees, Markdown, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import changes, history, render, tree, updates
from threadloom.sources import jsonl


def line(uuid, at=0, **more):
    return json.dumps({"sessionId": "s1", "timestamp": f"2024-01-01T00:00:{at:02d}Z", "uuid": uuid, **more})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("p")
    (d / "s1" / "subagents").mkdir(parents=True)
    use = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}
    result = {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": 'token = "abcdefgh"'}], "is_error": True}
    rows = [
        line("a", type="user", message={"role": "user", "content": "hello"}),
        line("b", 1, type="assistant", message={"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, use]}),
        line("c", 2, type="user", message={"role": "user", "content": [result, {"type": "image", "source": {"media_type": "image/png"}}, {"type": "text", "text": "<system-reminder>no"}]}),
        "{bad", "", "[1]", line("d", 3, type="result", costUSD=1.5, isError=False), line("e", type="odd"), '{"type":"user"}', json.dumps({"type": "user", "timestamp": "t", "uuid": "n", "sessionId": None, "message": {"role": "user", "content": "x"}}),
        json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:09Z", "uuid": "f", "message": {"role": "user", "content": "filled"}}),
    ]
    (d / "s1.jsonl").write_text("\n".join(rows) + '\n{"torn"')
    (d / "s1" / "subagents" / "agent-x.jsonl").write_text(line("z", 5, type="assistant", message={"role": "assistant", "content": "sub"}) + "\n")
    return d


@pytest.fixture(scope="module")
def lines(spark, folder):
    return jsonl.history(jsonl.lines(jsonl.files(spark, str(folder)))).withColumn("ord", F.col("line_number")).cache()


def test_lines_keep_their_place_and_status(spark, folder, lines):
    got = [(r["source_id"], r["line_number"], r["status"]) for r in lines.orderBy("source_id", "line_number").collect()]
    assert [s for _, _, s in got[1:]] == ["history", "history", "history", "malformed", "blank", "skipped", "history", "unknown", "degraded_history", "degraded_history", "history", "malformed"]
    data = (folder / "s1.jsonl").read_bytes()
    for r in lines.filter("source_id = 'main'").collect():
        assert data[r["byte_start"] : r["byte_end"]].decode().rstrip("\n") == r["value"]
    torn = jsonl.lines(jsonl.files(spark, str(folder)), require_newline=True)
    assert torn.count() == lines.count() - 1
    small = jsonl.lines(jsonl.files(spark, str(folder)), most_bytes=20)
    assert small.filter("status = 'oversized' and value is null").count() > 5


def test_records_and_discovery(spark, folder, lines):
    ids = [r["id"] for r in jsonl.raw_records(lines).collect()]
    assert "s1:main:a" in ids and any(i.startswith("s1:main:") and len(i) > 70 for i in ids) and len(ids) == 9
    found = jsonl.sessions(jsonl.files(spark, str(folder))).collect()
    assert [(r["session_id"], r["has_subagents"]) for r in found] == [("s1", True)]
    assert jsonl.sessions(jsonl.files(spark, str(folder)), after="2024-01-02T00:00:00Z").isEmpty()


def test_messages(lines):
    valid = lines.filter("status = 'history'")
    got = history.messages(valid, history.Denoise(tool_results=True, thinking=True)).orderBy("source_id", "ord").collect()
    assert [(r["role"], r["text"]) for r in got] == [("assistant", "sub"), ("user", "hello"), ("assistant", "[thinking]\nhm\n[/thinking]\n\nhi"), ("user", "[Image: image/png]"), ("user", "filled")]
    assert got[3]["errors"] == ['token = "[REDACTED:TOKEN]"'] and got[3]["tool_results"][0]["tool_name"] == "Bash" and got[2]["tool_calls"] == ["Bash(ls)"]


def test_blocks_and_headers(lines):
    valid = lines.filter("status = 'history'")
    got = {r["id"]: r for r in history.blocks(valid).collect()}
    assert {k: r["type"] for k, r in got.items()} == {"a:0": "user_text", "b:0": "thinking", "b:1": "assistant_text", "b:2": "tool_use", "c:0": "tool_result", "c:1": "user_text", "f:0": "user_text", "z:0": "assistant_text"}
    assert got["c:0"]["tool_name"] == "Bash" and got["c:0"]["is_error"] and got["b:2"]["summary"] == "Bash(ls)"
    head = history.headers(valid).first()
    assert (head["user_messages"], head["assistant_messages"], head["tool_calls"], head["errors"], head["cost_usd"], head["subagents"], head["duration_ms"]) == (3, 2, 1, 1, 1.5, 1, 9000)
    assert {(r["direction"], r["id"]) for r in history.boundaries(valid).collect()} == {("enter", "s1:agent-enter:agent-x"), ("exit", "s1:agent-exit:agent-x")}


def test_markdown(lines):
    valid = lines.filter("status = 'history'")
    said, heads = history.messages(valid, history.Denoise(tool_results=True, thinking=True)), history.headers(valid)
    text = render.markdown(said, heads).first()["markdown"]
    assert text.startswith("---\nsession: s1\n") and "cost: $1.5000" in text and "## Subagent: agent-x" in text and "*Tools:*\n- Bash(ls)" in text
    text = render.export_markdown(said, heads).first()["markdown"]
    assert "<details>" in text and "**Agent: x**" in text and "### Bash Result (error)" in text and text.index("sub") < text.index("filled")
    assert "> hello" in render.compact_summary(said, heads).first()["summary"]
    assert all("null" not in r["value"] for r in render.jsonl(history.blocks(valid).select("id", "tool_name")).collect())


def test_forward_fill_and_fold(spark):
    rows = spark.createDataFrame([("s", "main", 0, ""), ("s", "main", 5, "t1"), ("s", "main", 9, ""), ("s", "x", 0, "t0")], "session_id string, source_id string, byte_start long, timestamp string")
    got = {(r["source_id"], r["byte_start"]): r["effective_timestamp"] for r in history.forward_filled(rows, ["session_id", "source_id"], "byte_start", "timestamp").collect()}
    assert got == {("main", 0): "", ("main", 5): "t1", ("main", 9): "t1", ("x", 0): "t0"}
    log = spark.createDataFrame([("a", 1, "upsert", 1), ("b", 2, "upsert", 1), ("a", 3, "delete", 0), ("a", 4, "upsert", 7), ("b", 5, "delete", 0), ("a", 6, "upsert", 8)], "id string, ord int, op string, v int")
    assert [(r["id"], r["v"], r["first_order"]) for r in history.fold_changes(log, ["id"], "ord").collect()] == [("a", 8, 4)]


def reduced(rows):
    """Dialect B's blocks by going through the updates one by one."""
    blocks, streams, now = {}, {}, None
    kinds = updates.CHUNKS
    for start, u in rows:
        tag = u["sessionUpdate"]
        if tag in kinds and u["content"]["type"] == "text":
            prompt = u.get("_meta", {}).get("promptIndex")
            if tag == "user_message_chunk" and prompt is not None:
                now = prompt
            prompt = now if prompt is None else prompt
            corr = u.get("_meta", {}).get("promptId") or ("unscoped" if prompt is None else f"prompt-{prompt}")
            message = u.get("messageId") or streams.setdefault((kinds[tag], corr), f"{corr}:stream-{start}")
            old = blocks.get(f"S:{kinds[tag]}:{message}", {})
            blocks[f"S:{kinds[tag]}:{message}"] = {"content": old.get("content", "") + u["content"]["text"], "prompt": prompt}
        elif tag in ("tool_call", "tool_call_update"):
            key = f"S:tool_use:{u['toolCallId']}"
            sent = {k: u[k] for k in ("title", "kind", "status") if k in u}
            if tag == "tool_call":
                streams = {k: v for k, v in streams.items() if k[0] == "user_text"}
                blocks[key] = {"prompt": now, **sent}
            elif sent:
                blocks[key] = {**blocks.get(key, {"prompt": now, "title": u["toolCallId"]}), **sent}
            if tag == "tool_call_update" and u.get("status") in ("completed", "failed"):
                blocks[f"S:tool_result:{u['toolCallId']}"] = {"prompt": now, "status": u["status"]}
        elif tag == "turn_completed":
            streams = {}
        elif tag == "rewind_marker":
            streams, now = {}, u["target_prompt_index"]
            blocks = {k: b for k, b in blocks.items() if b["prompt"] is None or b["prompt"] <= now}
    return {k: (b.get("content"), b.get("title"), b.get("status")) for k, b in blocks.items()}


def updates_of(rng, n, rewinds):
    tags = [*updates.CHUNKS] * 3 + ["tool_call", "tool_call_update", "tool_call_update", "turn_completed", "unheard_of"] + ["rewind_marker"] * rewinds
    rows = []
    for k in range(n):
        tag = rng.choice(tags)
        u = {"sessionUpdate": tag}
        if tag in updates.CHUNKS:
            u |= {"content": {"type": rng.choice(["text"] * 5 + ["image"]), "text": f"<{k}>"}, "_meta": {}}
            if rng.random() < 0.4:
                u["_meta"]["promptIndex"] = rng.randrange(4)
            if rng.random() < 0.15:
                u["messageId"] = rng.choice("mn")
        elif tag.startswith("tool_call"):
            u |= {"toolCallId": rng.choice("xyz"), **({"title": f"T{k}"} if tag == "tool_call" or rng.random() < 0.3 else {}), **({"status": rng.choice(["pending", "completed", "failed"])} if rng.random() < 0.6 else {})}
        elif tag == "rewind_marker":
            u["target_prompt_index"] = rng.randrange(4)
        rows.append((10 * k, u))
    return rows


def test_updates_match_a_step_by_step_reduction(spark):
    import random

    rng = random.Random(3)
    logs = {f"S{i}": updates_of(rng, 60, i % 7) for i in range(500)}  # without rewinds to rich in them
    df = spark.createDataFrame([(s, "u", k, start, float(k), json.dumps(u), None) for s, rows in logs.items() for k, (start, u) in enumerate(rows)], "session_id string, source_id string, ord int, byte_start long, timestamp double, u string, meta_prompt_id string")
    got = {(r["session_id"], r["id"].removeprefix(r["session_id"])): (r["content"], r["title"], r["status"]) for r in updates.blocks(df).collect()}
    want = {(s, k.removeprefix("S")): v for s, rows in logs.items() for k, v in reduced(rows).items()}
    assert got == want


def test_envelopes_and_activities(spark):
    good = {"timestamp": 1.5, "method": "session/update", "params": {"sessionId": "S", "update": {"sessionUpdate": "x"}}}
    rows = [json.dumps(good), json.dumps({**good, "method": "other"}), "{bad", "{}"]
    got = updates.parse_envelopes(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r["status"] for r in got] == ["known", "unknown", "invalid", "invalid"] and got[0]["timestamp"] == 1500
    events = [{"type": "turn_started", "session_id": "S", "turn_number": 3}, {"type": "phase_changed", "phase": "plan"}, {"type": "tool_started", "tool_name": "rg"}, {"type": "tool_completed", "tool_name": "rg", "outcome": "ok"}, {"type": "goal_x"}]
    df = spark.createDataFrame([("S", "ev", k, float(k), json.dumps(e)) for k, e in enumerate(events)], "session_id string, source_id string, ord int, timestamp double, e string")
    assert {r["id"]: r["state"] for r in updates.activities(df).collect()} == {"ev:activity:turn:S:turn:3": "turn_started", "ev:activity:phase:S:turn:3": "plan", "ev:activity:tool:rg": "ok", "ev:activity:lifecycle:goal_x": "goal_x"}


ENTRY = "session_id string, ord int, id string, parent_id string, type string, first_kept_id string, retained array<string>, target_id string"


def entries(spark, rows):
    return spark.createDataFrame([("s", k, *r, *[None] * (6 - len(r))) for k, r in enumerate(rows)], ENTRY)


def test_tree_acceptance_paths_and_warnings(spark):
    rows = entries(spark, [("a", None, "message"), ("b", "a", "message"), ("c", "zz", "message"), ("d", "c", "message"), ("e", "b", "message"), ("b", "a", "message"), ("f", "h", "message"), ("g", "e", "label", None, None, "nope"), ("h", "g", "message"), ("i", "b", "message"), ("k", "f", "message"), ("c", "i", "message"), ("x", "y", "message"), ("y", "x", "message"), ("z", "y", "message"), ("", "a", "message")])
    ok = tree.accepted(rows)
    assert sorted(r["id"] for r in ok.collect()) == ["a", "b", "c", "e", "g", "h", "i"]
    assert [r["id"] for r in tree.root_path(ok).orderBy("place").collect()] == ["a", "b", "i", "c"]
    assert [r["id"] for r in tree.root_path(ok, "h").orderBy("place").collect()] == ["a", "b", "e", "g", "h"]
    assert sorted(r["id"] for r in tree.leaves(ok).collect()) == ["c", "h"]
    assert {r["id"]: r["disposition"] for r in tree.dispositions(ok).collect()}["e"] == "off_branch"
    assert sorted((r["code"], r["entry_id"]) for r in tree.warnings(rows).fillna("").collect()) == [("cycle", "x"), ("cycle", "y"), ("dangling_label_reference", "g"), ("duplicate_id", "b"), ("empty_id", ""), *(("missing_parent", x) for x in "cdfkz")]


@pytest.mark.parametrize(("kept", "retained", "want"), [("b", None, ["k", "b", "c", "z"]), (None, ["m", "n"], ["k", "retained:k:0", "retained:k:1", "z"]), ("b", [], ["k", "z"]), ("nope", None, ["k", "z"])])
def test_compaction(spark, kept, retained, want):
    rows = entries(spark, [("a", None, "message"), ("b", "a", "message"), ("c", "b", "message"), ("k", "c", "compaction", kept, retained), ("z", "k", "message")])
    assert [r["key"] for r in tree.compacted(rows).orderBy("place").collect()] == want
    found = {r["id"]: r["disposition"] for r in tree.dispositions(rows, compact=True).collect()}
    assert found["a"] == "summarized" and found["z"] == "active"


def test_mutation(spark):
    table = lambda keys: spark.createDataFrame([("s", i, k) for i, k in enumerate(keys)], "session_id string, place int, key string")
    got = changes.mutation(table("abcd"), table("abxyz")).first()
    assert (got["index"], got["delete_count"], got["insert_count"], got["removed_keys"]) == (2, 2, 3, ["c", "d"])
    assert changes.mutation(table("ab"), table("ab")).isEmpty()


def test_stream_reads_what_the_batch_reads(spark, tmp_path):
    from threadloom.streaming.tail import follow

    logs, state, out = tmp_path / "logs", tmp_path / "state", tmp_path / "out"
    logs.mkdir()
    file = logs / "s.jsonl"

    def run():
        query = follow(spark, str(logs)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.read.parquet(str(out)).orderBy("byte_start", "value").select("byte_start", "byte_end", "value").collect()]

    file.write_text('{"a":1}\nééé\ntor')
    assert run() == [(0, 8, '{"a":1}'), (8, 15, "ééé")]
    with file.open("a") as f:
        f.write("n\n\nlast")
    assert run()[2:] == [(15, 20, "torn"), (20, 21, "")]
    file.write_text("new\n")
    assert (0, 4, "new") in run()
    with file.open("a") as f:
        f.write("more\n")
    run()
    file.write_text("other\n")
    run()
    keys = [tuple(r) for r in spark.read.parquet(str(out)).select("path", "generation", "byte_start").collect()]
    generations = [{r["generation"] for r in spark.read.parquet(str(out)).filter(F.col("value").isin(*values)).collect()} for values in (['{"a":1}', "torn"], ["new", "more"], ["other"])]
    assert len(keys) == len(set(keys)) == 7 and all(len(g) == 1 for g in generations) and len(set.union(*generations)) == 3
    batch = [(r["byte_start"], r["value"]) for r in jsonl.lines(jsonl.files(spark, str(logs)), require_newline=True).collect()]
    assert batch == [(0, "other")]
