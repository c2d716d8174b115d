"""Hook envelopes and tool inputs: every event and tool, every field, and the codes."""

import json

import pytest

from threadloom.functions import shape
from threadloom.operators import envelopes

GOOD = {"some": "x", "string": "", "positive": 0.5, "nonnegative": 0, "unsigned": 3, "number": -0.5, "boolean": True, "object": {}, "array": [], "strings": ["a"]}
ITEMS = {
    "background_tasks": [{"id": "i", "type": "t", "status": "s", "description": ""}], "session_crons": [{"id": "i", "schedule": "s", "recurring": True, "prompt": ""}], "tool_calls": [{"tool_name": "n", "tool_input": {}, "tool_use_id": "u", "tool_response": []}],
    "edits": [{"old_string": "", "new_string": ""}], "todos": [{"content": "c", "status": "pending", "activeForm": "a"}], "questions": [{"question": "q", "header": "h", "options": [{"label": "l"}]}], "allowedPrompts": [{"tool": "t", "prompt": ""}],
}


def sample(key, kind):
    return ITEMS.get(key) or (kind[1:].split("|")[0] if kind.startswith("=") else GOOD[kind])


def judged(spark, f, rows):
    df = spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "k int, value string")
    return [(r["code"], [tuple(x) for x in r["issues"] or ()]) for r in f(df).orderBy("k").collect()]


def cases(own, wrap, code, at=""):
    """(value, code, issues) for each field of a kind: absent, of another kind, null, empty, and of another value."""
    whole = {key: sample(key, kind) for _, key, kind, _ in own}
    needed = {key: sample(key, kind) for _, key, kind, maybe in own if not maybe}
    yield wrap(whole), None, []
    yield wrap(needed), None, []
    for _, key, kind, maybe in own:
        path = f"{at}{key}"
        yield wrap({k: v for k, v in whole.items() if k != key}), *((None, []) if maybe else (code, [("missing", path)]))
        yield wrap(whole | {key: 5 if kind != "number" else "5"}), *((None, []) if kind in ("positive", "nonnegative", "unsigned") else (code, [("wrong_type", path)]))
        yield wrap(whole | {key: None}), code, [("wrong_type", path)]
        if kind in ("some", "positive", "nonnegative"):
            yield wrap(whole | {key: {"some": "", "positive": 0, "nonnegative": -1}[kind]}), code, [("wrong_type", path)]
        if kind.startswith("="):
            yield wrap(whole | {key: "something else"}), code, [("wrong_value", path)]
        if key in ITEMS:
            yield wrap(whole | {key: [*ITEMS[key], 5]}), code, [("wrong_items", path)]


def same(got, want, rows):
    assert [(r, g, w) for r, g, (w) in zip(rows, got, want, strict=True) if (g[0], sorted(g[1])) != (w[0], sorted(w[1]))] == []


def test_every_event(spark):
    base = {"session_id": "s", "transcript_path": "t", "cwd": "c"}
    table = shape.rules_of_text(envelopes.EVENTS)
    assert len(table) == 30
    told = [case for event, own in table.items() for case in cases(own, lambda fields, event=event: {**base, "hook_event_name": event, **fields}, "HOOK_VALIDATION_FAILED")]
    stop = {**base, "hook_event_name": "Stop", "stop_hook_active": False}
    told += [(stop | {"effort": {"level": "low"}, "permission_mode": "plan"}, None, []), (stop | {"effort": {"level": "none"}}, "HOOK_VALIDATION_FAILED", [("wrong_value", "effort.level")]), (stop | {"cwd": ""}, "HOOK_VALIDATION_FAILED", [("wrong_type", "cwd")]), (stop | {"permission_mode": "x"}, "HOOK_VALIDATION_FAILED", [("wrong_value", "permission_mode")])]
    told += [(base | {"hook_event_name": "PostToolBatch", "tool_calls": []}, "HOOK_VALIDATION_FAILED", [("wrong_size", "tool_calls")])]
    told += [(base, "MISSING_HOOK_EVENT_NAME", []), (base | {"hook_event_name": 5}, "MISSING_HOOK_EVENT_NAME", []), (base | {"hook_event_name": "Other"}, "UNSUPPORTED_HOOK_EVENT", []), ([1], "INVALID_INPUT_TYPE", []), ("{torn", "INVALID_INPUT_TYPE", []), ('"x"', "INVALID_INPUT_TYPE", [])]
    rows = [r for r, *_ in told]
    same(judged(spark, envelopes.hook_envelopes, rows), [tuple(x) for _, *x in told], rows)


def test_every_tool(spark):
    table = shape.rules_of_text(envelopes.TOOLS)
    assert len(table) == 14
    told = [case for tool, own in table.items() for case in cases(own, lambda fields, tool=tool: {"tool_name": tool, "tool_input": fields}, "TOOL_VALIDATION_FAILED", "tool_input.")]
    given = lambda tool, value: {"tool_name": tool, "tool_input": value}
    wrong = [("wrong_type", "tool_input")]
    told += [(given("Bash", "ls"), "TOOL_VALIDATION_FAILED", wrong), (given("mcp__a__b", {"any": 1}), None, []), (given("mcp__a__b", [1]), "MCP_TOOL_VALIDATION_FAILED", wrong), (given("Other", {}), "UNSUPPORTED_TOOL", []), ({"tool_input": {}}, "UNSUPPORTED_TOOL", []), ("{torn", "UNSUPPORTED_TOOL", [])]
    told += [(given("AskUserQuestion", {"questions": ITEMS["questions"] * n}), "TOOL_VALIDATION_FAILED", [("wrong_size", "tool_input.questions")]) for n in (0, 5)]
    rows = [r for r, *_ in told]
    same(judged(spark, envelopes.tool_inputs, rows), [tuple(x) for _, *x in told], rows)


@pytest.mark.parametrize(("value", "kind"), [("0", "zero"), ("3", "unsigned"), ("2.5", "positive"), ("-1", "number"), ("-0.5", "number"), ('""', "string"), ("[]", "none"), ('["a"]', "strings"), ("[1]", "array"), ("{}", "object"), ("null", "null"), ("true", "boolean")])
def test_kinds(spark, value, kind):
    from pyspark.sql import functions as F

    assert spark.range(1).select(shape.kind_of(F.try_parse_json(F.lit(value))).alias("k")).first().k == kind
