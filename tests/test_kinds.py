"""Dialect B's events: every kind, fields that are missing or wrong, and diagnostics."""

import json

from threadloom.functions import shape
from threadloom.operators import kinds

GOOD = {"string": "x", "unsigned": 3, "number": 0.5, "boolean": True, "array": [], "strings": ["a"]}


def sample(kind):
    kind = kind.removesuffix("|null")
    return kind[1:].split("|")[0] if kind.startswith("=") else GOOD[kind]


def events_of(spark, rows):
    df = spark.createDataFrame([("p", 10 * k, 10 * k + 9, "ok", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "path string, byte_start long, byte_end long, status string, value string")
    return kinds.events(df).orderBy("byte_start")


def test_every_kind_and_every_field(spark):
    table = shape.rules_of_text(kinds.EVENTS)
    assert len(table) == 57
    rows, want = [], []
    for tag, own in table.items():
        whole = {"type": tag, "ts": "t", **{key: sample(kind) for _, key, kind, _ in own}}
        needed = {"type": tag, "ts": "t", **{key: sample(kind) for _, key, kind, maybe in own if not maybe}}
        rows += [whole, needed, {k: v for k, v in whole.items() if k != "ts"}]
        want += [("known", []), ("known", []), ("invalid", [("missing", "ts")])]
        for _, key, kind, maybe in own:
            rows += [{k: v for k, v in whole.items() if k != key}, whole | {key: {"an": "object"}}, whole | {key: None}]
            want += [("known", []) if maybe else ("invalid", [("missing", key)]), ("invalid", [("wrong_type", key)]), ("invalid", [("wrong_type", key)])]
            if kind.startswith("="):
                rows.append(whole | {key: "something else"})
                want.append(("invalid", [("wrong_value", key)]))
            if kind == "unsigned":
                rows += [whole | {key: -1}, whole | {key: 1.5}, whole | {key: 0}]
                want += [("invalid", [("wrong_type", key)])] * 2 + [("known", [])]
    got = [(r["record_kind"], [tuple(x) for x in r["issues"]]) for r in events_of(spark, rows).collect()]
    assert got == want


def test_unknown_and_invalid_records_and_diagnostics(spark):
    server = {"name": "n", "transport": "t", "source": "s"}
    config = {"type": "mcp_config_resolved", "ts": "t", "disabled": []}
    rows = [{"type": "unheard_of", "x": 1}, {"type": 5}, {}, [1], "5", "{torn", config | {"servers": [server]}, config | {"servers": [server, {"name": "n"}]}, config | {"servers": [1]}, {"type": "loop_started", "ts": 5}]
    got = events_of(spark, rows)
    assert [r["record_kind"] for r in got.collect()] == ["unknown", "invalid", "invalid", "invalid", "invalid", None, "known", "invalid", "invalid", "invalid"]
    told = [tuple(r) for r in kinds.diagnostics(got).orderBy("byte_start").collect()]
    assert told[-1] == ("p", 90, 99, "invalid_record", "loop_started", "wrong_type ts; missing loop_index") and told[4][3] == "invalid_json" and len(told) == 8


def test_every_update_in_its_envelope(spark):
    text = {"type": "text", "text": "x"}
    rows, want = [], []

    def case(update, kind, method, issues=(), **params):
        rows.append({"timestamp": 1, "method": method, "params": {"sessionId": "S", "update": update, **params}})
        want.append((kind, list(issues)))

    for method, table in zip(kinds.METHODS, map(shape.rules_of_text, (kinds.SESSION_UPDATES, kinds.OWN_UPDATES)), strict=True):
        other = kinds.METHODS[1 - kinds.METHODS.index(method)]
        for tag, own in table.items():
            value = lambda key, kind: text if key == "content" and kind == "object" else {} if kind == "object" else sample(kind)
            whole = {"sessionUpdate": tag, **{key: value(key, kind) for _, key, kind, _ in own}}
            case(whole, "known", method)
            case(whole, "unknown", other)
            for _, key, kind, maybe in own:
                case({k: v for k, v in whole.items() if k != key}, "known" if maybe else "invalid", method, [] if maybe else [("missing", f"params.update.{key}")])
                case(whole | {key: None}, "known" if kind.endswith("null") else "invalid", method, [] if kind.endswith("null") else [("wrong_type", f"params.update.{key}")])
    chunk, call = {"sessionUpdate": "agent_message_chunk"}, {"sessionUpdate": "tool_call", "toolCallId": "c", "title": "t"}
    for update, kind in (
        (chunk | {"content": {"type": "image", "data": "d", "mimeType": "m"}}, "known"), (chunk | {"content": {"type": "image"}}, "invalid"), (chunk | {"content": {"type": "video"}}, "invalid"), (chunk | {"content": {"text": "x"}}, "invalid"),
        (call | {"content": [{"type": "content", "content": text}, {"type": "diff", "path": "p", "newText": "n", "oldText": None}], "locations": [{"path": "p", "line": 3}]}, "known"), (call | {"content": [{"type": "diff", "path": "p"}]}, "invalid"), (call | {"content": [5]}, "invalid"), (call | {"locations": [{"line": 3}]}, "invalid"),
        ({"sessionUpdate": "plan", "entries": [{"content": "c", "priority": "high", "status": "pending"}]}, "known"), ({"sessionUpdate": "plan", "entries": [{"content": "c", "priority": "urgent", "status": "pending"}]}, "invalid"), ({"sessionUpdate": "available_commands_update", "availableCommands": [{"name": "n"}]}, "invalid"),
    ):
        case(update, kind, kinds.METHODS[0])
    case({"sessionUpdate": "unheard_of"}, "unknown", kinds.METHODS[0])
    case({}, "invalid", kinds.METHODS[0], [("missing", "params.update.sessionUpdate")])
    case("x", "invalid", kinds.METHODS[0], [("wrong_type", "params.update")])
    case({"sessionUpdate": "retry_state"}, "invalid", "other", [("wrong_value", "method")])
    case({"sessionUpdate": "retry_state"}, "invalid", kinds.METHODS[1], [("wrong_type", "params.sessionId")], sessionId=5)
    rows += [{"timestamp": "1", "method": kinds.METHODS[1]}, [1], "{torn"]
    want += [("invalid", [("wrong_type", "timestamp"), ("missing", "params")]), ("invalid", []), (None, None)]
    df = spark.createDataFrame([("p", 10 * k, 10 * k + 9, "ok", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "path string, byte_start long, byte_end long, status string, value string")
    told = kinds.envelopes(df)
    got = [(r["record_kind"], None if r["issues"] is None else [tuple(x) for x in r["issues"]]) for r in told.orderBy("byte_start").collect()]
    assert [(rows[k], *g) for k, g in enumerate(got) if g != want[k]] == []
    assert kinds.normalised(told).count() == sum(k in ("known", "unknown") for k, _ in want) and kinds.normalised(told).select("origin").distinct().count() == kinds.normalised(told).count()
