"""Dialect C's lines as entries, blocks and a listing."""

import json

from threadloom.operators import entries
from threadloom.sources import jsonl


def entry(tag, id_, parent=None, **more):
    return json.dumps({"type": tag, "id": id_, "parentId": parent, "timestamp": "t", **more})


def test_entries_blocks_and_listing(spark, tmp_path):
    header = json.dumps({"type": "session", "version": 3, "id": "s", "timestamp": "t", "cwd": "/a"})
    two = [{"type": "text", "text": "hi"}, {"type": "image", "data": "x", "mimeType": "image/png"}]
    rows = [
        header, entry("message", "m1", message={"role": "user", "content": "hello", "timestamp": 1}), entry("message", "m2", "m1", message={"role": "user", "content": two, "timestamp": 2}),
        entry("message", "m3", "m2", message={"role": "bashExecution", "command": "ls", "output": "out", "cancelled": False, "truncated": False, "timestamp": 3}),
        entry("label", "l", "m3", targetId="m1", label="x"), entry("odd", "o", "l", more=1), entry("session_info", "n", "o", name="first"), entry("session_info", "n2", "n", name="last"), "",
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    bad = [header, entry("label", "l", targetId="m1", label=5), entry("message", "m", message={"role": "user", "content": "x"}), json.dumps({"type": "odd"}), "[1]", "{torn"]
    (tmp_path / "b.jsonl").write_text("\n".join(bad) + "\n")
    (tmp_path / "c.jsonl").write_text(entry("label", "l", targetId="m", label="x") + "\n")
    told = entries.parsed(jsonl.lines(jsonl.files(spark, str(tmp_path)))).cache()
    name = lambda r: r["path"][-7]
    kinds = {(name(r), r["line_number"]): (r["entry_kind"], r["diagnostic"]) for r in told.collect()}
    assert [kinds["a", i][0] for i in range(1, 9)] == ["known"] * 5 + ["unknown"] + ["known"] * 2
    assert [kinds["b", i] for i in range(1, 7)] == [("known", None)] + [("invalid", "invalid_entry")] * 4 + [(None, "invalid_json")]
    assert {name(r): (r["session_id"], r["successful"], r["terminal_malformed"]) for r in entries.files(told).collect()} == {"a": ("s", True, False), "b": ("s", False, True), "c": (None, False, False)}
    got = {r["id"]: r for r in entries.blocks(told).collect() if name(r) == "a"}
    assert list(sorted(got)) == ["l", "m1", "m2:0", "m2:1", "m3", "n", "n2", "o"]
    assert json.loads(got["m1"]["content"]) == [{"type": "text", "text": "hello"}] and json.loads(got["m2:1"]["content"]) == [two[1]] and json.loads(got["m3"]["content"])[0]["text"] == "out"
    assert json.loads(got["l"]["payload"]) == {"targetId": "m1", "label": "x"} and json.loads(got["o"]["payload"])["more"] == 1 and got["m1"]["payload"] is None
    listed = {name(r): r for r in entries.listing(told, "/a").collect()}
    assert (listed["a"]["message_count"], listed["a"]["first_message"], listed["a"]["name"], listed["a"]["error"]) == (3, "hello", "last", None)
    assert listed["b"]["error"] == "invalid_entry" and listed["c"]["error"] == "invalid_session_header"
    assert {name(r) for r in entries.listing(told, "/other").collect()} == {"c"}


def test_messages_of_all_roles_and_what_does_not_fit(spark):
    usage = {"input": 1, "output": 2, "cacheRead": 0, "cacheWrite": 0, "totalTokens": 3, "cost": {"input": 0.1, "output": 0, "cacheRead": 0, "cacheWrite": 0, "total": 0.1}}
    text = {"type": "text", "text": "x"}
    good = {
        "user": {"content": [text, {"type": "image", "data": "d", "mimeType": "m"}]},
        "assistant": {"content": [text, {"type": "thinking", "thinking": "t", "startedAt": 1}, {"type": "toolCall", "id": "i", "name": "n", "arguments": {}}], "api": "a", "provider": "p", "model": "m", "usage": usage, "stopReason": "toolUse"},
        "toolResult": {"toolCallId": "c", "toolName": "n", "content": [text], "isError": False, "usage": usage},
        "bashExecution": {"command": "c", "output": "o", "cancelled": False, "truncated": False, "exitCode": 1},
        "custom": {"customType": "c", "content": "plain", "display": True},
        "branchSummary": {"summary": "s", "fromId": "f"},
        "compactionSummary": {"summary": "s", "tokensBefore": 5},
    }
    said = lambda role, **more: {"role": role, **good[role], "timestamp": 1, **more}
    bad_cost = usage | {"cost": usage["cost"] | {"total": "free"}}
    cases = [(entry("message", "m", message=said(role)), "known") for role in good]
    cases += [(entry("message", "m", message=m), "invalid") for m in (
        said("user", content=[5]), said("user", content=[{"type": "thinking", "thinking": "t"}]), said("user", content=[{"type": "text"}]), said("user", content=None), said("user", timestamp="t"),
        said("assistant", stopReason="pending"), said("assistant", usage={}), said("assistant", usage=bad_cost), said("assistant", content=[{"type": "image", "data": "d", "mimeType": "m"}]), said("assistant", content=[{"type": "toolCall", "id": "i", "name": "n", "arguments": []}]),
        said("assistant", content=[{"type": "thinking", "thinking": "t", "endedAt": "late"}]), said("assistant", errorMessage=5), said("toolResult", usage=bad_cost), said("toolResult", content="x"), said("bashExecution", exitCode=None), said("custom", display="yes"), {**said("user"), "role": "other"}, {"content": "x", "timestamp": 1}, [], "x",
    )]
    cases += [(entry("compaction", "c", summary="s", tokensBefore=1, **more), kind) for more, kind in (({}, "known"), ({"retainedTail": [said("user"), said("assistant")]}, "known"), ({"retainedTail": []}, "known"), ({"retainedTail": [said("user"), 5]}, "invalid"), ({"retainedTail": [said("assistant", stopReason=None)]}, "invalid"), ({"usage": usage}, "known"), ({"usage": bad_cost}, "invalid"), ({"firstKeptEntryId": None}, "invalid"), ({"fromHook": 1}, "invalid"))]
    cases += [(entry("custom_message", "c", customType="t", display=True, content=c), kind) for c, kind in (("x", "known"), ([text], "known"), ([5], "invalid"), ({}, "invalid"))]
    cases += [(entry("odd", "o", 5), "invalid"), (entry("odd", "o", more=[1]), "unknown"), (json.dumps({"type": 5, "id": "x"}), "invalid"), ("[1]", "invalid"), ("5", "invalid"), ("{torn", None), (json.dumps({"type": "session", "version": 3, "id": "s", "timestamp": "t", "cwd": "/", "parentSession": None}), "invalid")]
    df = spark.createDataFrame([("p", k, "ok", value) for k, (value, _) in enumerate(cases)], "path string, line_number long, status string, value string")
    got = {r["line_number"]: r for r in entries.parsed(df).collect()}
    assert [(cases[k][0], got[k]["entry_kind"]) for k in range(len(cases))] == cases
    told = {tuple(map(tuple, got[k]["issues"] or ())) for k in range(len(cases))}
    assert (("wrong_type", "parentId"),) in told and (("wrong_type", "usage.cost.total"),) in told and (("wrong_type", "firstKeptEntryId"),) in told


def test_issues_have_a_code_and_a_path(spark):
    df = spark.createDataFrame([("p", 1, "ok", json.dumps({"type": "label", "id": 5, "parentId": None, "label": "x"}))], "path string, line_number long, status string, value string")
    assert sorted(map(tuple, entries.parsed(df).first()["issues"])) == [("missing", "targetId"), ("missing", "timestamp"), ("wrong_type", "id")]
