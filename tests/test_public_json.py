"""Strings of JSON out of sight, at any depth, and the records that are shown."""

import json
import random

from pyspark.sql import functions as F

from threadloom.functions.text import public_json
from threadloom.sources import jsonl

PLACEHOLDER = "[REDACTED:RAW_TRANSCRIPT_VALUE]"


def hidden(x):
    if isinstance(x, str):
        return PLACEHOLDER
    if isinstance(x, list):
        return [hidden(y) for y in x]
    return {k: hidden(y) for k, y in x.items()} if isinstance(x, dict) else x


def value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ":", " ", "é", "\n", "{", "a", "\x07", "😀", ","]) for _ in range(rng.randrange(8)))
    if kind < 6:
        return rng.choice([1, -2.5, 1e30, True, False, None, 0])
    if kind == 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice(['"', "\\", ":", "k", "é"]) for _ in range(rng.randrange(4))): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_random_json(spark):
    rng = random.Random(6)
    values = [value(rng, 4) for _ in range(600)]
    texts = [json.dumps(v, ensure_ascii=bool(k % 2), indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":"), (" , ", " : ")])) for k, v in enumerate(values)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.p for r in df.select("k", public_json(F.col("t")).alias("p")).collect()}
    assert all(json.loads(got[k]) == hidden(json.loads(texts[k])) for k in got)


def test_long_and_broken_texts(spark):
    long = json.dumps({"a": ['x"\\\n' * 100_000, 1], "b": "y"})
    df = spark.createDataFrame([(0, long), (1, "{torn"), (2, None), (3, '""'), (4, "5")], "k int, t string")
    got = {r.k: r.p for r in df.select("k", public_json(F.col("t")).alias("p")).collect()}
    assert json.loads(got[0]) == {"a": [PLACEHOLDER, 1], "b": PLACEHOLDER} and (got[1], got[2], json.loads(got[3]), got[4]) == (None, None, PLACEHOLDER, "5")


def test_public_records(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"sessionId": "s", "timestamp": "t", "uuid": "u", "type": "user", "message": {"role": "user", "content": "secret", "n": [1, None]}}) + "\n")
    records = jsonl.raw_records(jsonl.history(jsonl.lines(jsonl.files(spark, str(tmp_path)))))
    shown, whole = jsonl.public_records(records).first(), jsonl.public_records(records, unsafe=True).first()
    assert shown["raw_line"] == "[REDACTED:RAW_TRANSCRIPT_LINE]" and shown["id"] == whole["id"] == "s:main:u"
    assert json.loads(shown["payload"]) == hidden(json.loads(whole["payload"])) and whole["payload"] == whole["raw_line"] and "secret" in whole["payload"]
