"""Decisions on literal rows."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import decisions


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return row.select(f(*(F.col(f"x{i}") for i in range(len(values)))).alias("y")).first()["y"]


@pytest.mark.parametrize(("command", "want"), [(" git status", "allow"), ("lsof -i", "allow"), ("rm -rf /x", "deny"), ("chmod 777 x", "ask"), ("make", "pass"), ("tool --help", "allow"), ("grep x y", "ask")])
def test_bash_decision(spark, command, want):
    assert one(spark, decisions.bash_decision, command) == want


def test_prompts(spark):
    assert one(spark, decisions.prompt_decision, "password = hunter22 please").asDict() == {"decision": "block", "reasons": ["Password detected"]}
    assert one(spark, decisions.prompt_decision, "x" * 10_001)["decision"] == "block" and one(spark, decisions.prompt_decision, "hi")["decision"] == "warn"
    assert one(spark, decisions.prompt_decision, "please look at this file")["decision"] == "pass"


def test_classes(spark):
    assert one(spark, decisions.failure_hint, "bash: foo: Command not found").startswith("Command not found") and one(spark, decisions.failure_hint, "fine") is None
    kind = lambda m, t: one(spark, decisions.notification_class, m, t)
    assert [kind("x", "idle_prompt"), kind("It Failed", None), kind("please approve", None), kind("done", None)] == ["waiting", "error", "permission", "info"]
    assert one(spark, decisions.notification_priority, "error") == "high"
    assert one(spark, decisions.task_type, '{"tool_name":"Bash"}') == "command-execution" and one(spark, decisions.task_type, "{}") == "general-task"
    assert one(spark, lambda t, e: decisions.critical_errors(t, F.array(e)), "web-research", "Timeout!") == ["Critical error detected: timeout"]


def test_transcript_numbers(spark):
    text = '{"timestamp":"t0","tool_name":"Write","x":{"file_path":"a.py"}}\n{"tool_name":"Bash"} Error: Failed to\n{"tool_name":"Edit","file_path":"node_modules/x"}'
    got = one(spark, decisions.transcript_numbers, text)
    assert (got["commands"], got["errors"], got["tools"], got["files"], got["start_time"]) == (1, 2, ["Write", "Bash", "Edit"], ["a.py"], "t0")
