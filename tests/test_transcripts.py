"""Transcript analysis against a brute-force version."""

import json
import random
import re

from pyspark.sql import functions as F

from threadloom.functions import transcripts

LINE = r"[^\n\r  ]"


def units(s):
    return len(s.encode("utf-16-be")) // 2


def found(pattern, text, flags=re.I):
    return [m[1] if m.re.groups else m[0] for m in re.finditer(pattern.replace("DOT", LINE), text, flags)]


def brute_lists(t):
    distinct = lambda xs: list(dict.fromkeys(xs))
    decisions = []
    for p in ("decided to use", "chose to implement", "will useDOT*instead of", "opted for", "selectedDOT*approach"):
        decisions += found(f"(DOT{{0,50}}{p}DOT{{0,100}})", t)[:3]
    after = lambda starts, below: [x.strip() for s in starts for x in found(f"{s}(DOT+)", t) if x.strip() and units(x.strip()) < below]
    changes = distinct([x for tool in ("Write", "Edit", "MultiEdit") for x in found(f'"tool_name":"{tool}"DOT*"file_path":"([^"]+)"', t, 0)])
    files = distinct([x for key in ("file_path", "path") for x in found(f'"{key}":"([^"]+)"', t, 0) if "node_modules" not in x and ".git" not in x])
    return decisions[:10], changes[:20], after((r"TODO:?\s*", r"FIXME:?\s*", r"need to\s+", r"should\s+", r"will\s+"), 200)[:15], after((r"Error:?\s*", r"Failed to\s+", r"Cannot\s+", r"TypeError:?\s*"), 300)[:10], files[:25]


def transcript(rng):
    said = ["we decided to use " + "x" * rng.randrange(150), "will use a instead of b, opted for c", "TODO: write it", "todo   " + "y" * rng.randrange(150, 260), "FIXME", "you should  test more", "Error: bad\r", "TypeError: worse", "failed to run " * rng.randrange(1, 40), "selected the é approach", "😀 need to go", "Should use that", "Warning: old Deprecated Deprecated"]
    tools = [f'{{"tool_name":"{rng.choice(["Write", "Edit", "Bash", "MultiEdit"])}","file_path":"/a/{rng.randrange(60)}","path":"/{rng.choice(["b", ".git", "node_modules"])}/{k}"}}' for k in range(120)]
    return "\n".join(rng.choice(said * 3 + tools) for _ in range(rng.randrange(160)))


def test_lists_and_caps(spark):
    rng = random.Random(12)
    texts = [transcript(rng) for _ in range(150)] + ["", None, "TODO:"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: tuple(r.x) for r in df.select("k", transcripts.before_compaction(F.col("t")).alias("x")).collect()}
    assert [(k, got[k]) for k in got if got[k] != brute_lists(texts[k] or "")] == []
    assert max(len(x[1]) for x in got.values()) == 20 and max(len(x[2]) for x in got.values()) == 15


def brute_errors(x):
    if isinstance(x, list):
        return [e for y in x for e in brute_errors(y)]
    if not isinstance(x, dict):
        return []
    said = next((x[k].strip() for k in ("message", "error", "content") if isinstance(x.get(k), str) and x[k].strip()), "Structured subagent error")
    return [said] * ((x.get("is_error") is True) + (x.get("type") in ("error", "tool_error"))) + [e for y in x.values() for e in brute_errors(y)]


def tree_of(rng, depth):
    node = {}
    for key in rng.sample(["is_error", "type", "message", "error", "content", "below", "more"], rng.randrange(7)):
        node[key] = tree_of(rng, depth - 1) if depth and rng.random() < 0.3 else [tree_of(rng, depth - 1)] * 2 if depth and rng.random() < 0.2 else rng.choice([True, False, "error", "tool_error", " said ", "", 5, None])
    return node


def test_errors_at_any_depth(spark):
    rng = random.Random(13)
    lines = [[tree_of(rng, 5) for _ in range(rng.randrange(5))] for _ in range(200)]
    df = spark.createDataFrame([(k, "\n".join(["{torn", *map(json.dumps, own), "", '{"is_error":true,"n":NaN}'])) for k, own in enumerate(lines)], "k int, t string")
    got = {r.k: r.e for r in df.select("k", transcripts.structured_errors("t").alias("e")).collect()}
    assert all(got[k] == [e for x in own for e in brute_errors(x)] for k, own in enumerate(lines)) and sum(map(len, got.values())) > 200


def test_subagents(spark):
    own = "\n".join([json.dumps({"timestamp": "2024-01-01T00:00:00Z", "tool_name": "Bash"}, separators=(",", ":")), json.dumps({"is_error": True, "type": "error", "message": "no"}), "Warning: a Warning: b", '{"timestamp":"2024-01-01T00:00:02.500Z"}'])
    rows = [(0, own, "parent", None), (1, " \n", own, "All done. Error: no\nError: no\ncannot go"), (2, None, "", "fine"), (3, None, None, None), (4, "x😀", None, "Should use y")]
    df = spark.createDataFrame(rows, "k int, own string, parent string, final string")
    got = {r.k: r.x for r in df.select("k", transcripts.subagent_analysis(F.col("own"), F.col("parent"), F.col("final")).alias("x")).collect()}
    warned = ["Found 2 instances of 'Warning:'"]
    assert tuple(got[0]) == ("command-execution", False, ["no", "no"], warned, units(own), ["Bash"], 2500)
    assert tuple(got[1]) == ("command-execution", False, ["no", "no", "Error: no", "cannot go"], warned, units(own), ["Bash"], 2500)
    assert tuple(got[2]) == ("unknown", True, [], [], 4, [], None) and tuple(got[3]) == ("unknown", True, [], [], 0, [], None)
    assert tuple(got[4]) == ("general-task", True, [], ["Found 1 instances of 'Should use'"], 12, [], None)
