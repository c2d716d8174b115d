"""A session's tail as a stream over growing files gives what the batch gives over whole ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import history
from threadloom.sources import jsonl

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def session(rng, source, n):
    """Lines of one file: calls, results that come later, lines without a time, and lines that are no history."""
    out, open_calls = [], []
    for k in range(n):
        time = "" if rng.random() < 0.2 else f"2024-01-01T00:{rng.randrange(60):02d}:00Z"
        row = {"sessionId": "s", "timestamp": time or "t", "uuid": f"{source}{k}"}
        kind = rng.randrange(7)
        if kind < 2:
            call = f"{source}-c{k}"
            open_calls.append(call)
            row |= {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": f"é {k}"}, {"type": "tool_use", "id": call, "name": rng.choice(["Bash", "Read"]), "input": {"command": f"ls {k}"}}]}}
        elif kind < 4:
            of = open_calls.pop(rng.randrange(len(open_calls))) if open_calls else "nowhere"
            row |= {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": of, "content": f"out {k}", "is_error": kind == 3}]}}
        elif kind == 4:
            row |= {"type": "user", "message": {"role": "user", "content": f"plain {k}"}}
        elif kind == 5:
            row |= {"type": "odd"} if time else {"type": "odd", "timestamp": ""}
        out.append(rng.choice(["{torn", "", "[1]"]) if kind == 6 else json.dumps(row))
    return ("\n".join(out) + "\n").encode()


def test_blocks_and_records_of_growing_files(spark, rocks, tmp_path):
    from threadloom.streaming.session_tail import tail_blocks, tail_records
    from threadloom.streaming.tail import follow

    rng = random.Random(4)
    logs = tmp_path / "logs"
    (logs / "s" / "subagents").mkdir(parents=True)
    files = {logs / "s.jsonl": session(rng, "m", 120), logs / "s" / "subagents" / "agent-x.jsonl": session(rng, "x", 60)}

    def run(name, made):
        made(follow(spark, str(logs))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()

    cuts = {f: [*sorted(rng.sample(range(len(data)), 3)), len(data)] for f, data in files.items()}
    for k in range(4):  # each a query that starts again
        for f, data in files.items():
            with f.open("ab") as out:
                out.write(data[(cuts[f][k - 1] if k else 0) : cuts[f][k]])
        run("blocks", tail_blocks)
        run("records", tail_records)

    lines = jsonl.history(jsonl.lines(jsonl.files(spark, str(logs)))).withColumn("ord", F.col("line_number"))
    want = history.blocks(lines.filter("status = 'history'"))
    got = spark.read.parquet(str(tmp_path / "blocks"))
    assert got.select("generation").distinct().count() == 1
    rows = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(want.columns).collect())
    assert rows(got) == rows(want) and got.filter("type = 'tool_result' and tool_name is not null").count() > 20

    records, whole = spark.read.parquet(str(tmp_path / "records")), jsonl.raw_records(lines)
    plain = [c for c in whole.columns if c != "source_path"]
    assert sorted(map(str, (tuple(r) for r in records.select(plain).collect()))) == sorted(map(str, (tuple(r) for r in whole.select(plain).collect())))
    filled = history.forward_filled(whole, ["session_id", "source_id"], "byte_start", "timestamp")
    times = lambda df: {(r["source_id"], r["byte_start"]): r["effective_timestamp"] for r in df.collect()}
    assert times(records) == times(filled) and records.filter("effective_timestamp != timestamp").count() > 0
    merged = [r["id"] for r in history.merged(records.drop("effective_timestamp")).collect()]
    assert merged == [r["id"] for r in history.merged(whole).collect()]


def test_a_new_generation_forgets_the_old(spark, rocks, tmp_path):
    from threadloom.streaming.session_tail import tail_blocks
    from threadloom.streaming.tail import follow

    logs = tmp_path / "logs"
    logs.mkdir()
    call = {"sessionId": "s", "timestamp": "t1", "uuid": "a", "type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "Bash", "input": {}}]}}
    result = {"sessionId": "s", "timestamp": "t2", "uuid": "b", "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c", "content": "out"}]}}

    def run():
        tail_blocks(follow(spark, str(logs))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.generation, r.id, r.tool_name, r.emit_seq.ord) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (logs / "s.jsonl").write_text(json.dumps(call) + "\n")
    run()
    with (logs / "s.jsonl").open("a") as f:
        f.write(json.dumps(result) + "\n")
    assert run() == [(0, "a:0", "Bash", 1), (0, "b:0", "Bash", 2)]
    (logs / "s.jsonl").write_text(json.dumps(result) + "\n")
    assert run()[2:] == [(1, "b:0", None, 1)]
