"""Cursors: reasons to start again, limits of a pass, oversized lines, and the stream on them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom.streaming.cursor import REASONS, Cursor, Limits, advanced, invalidation, lines_between, reset_reason


def passes(path, cursor=None, limits=Limits()):
    """All lines from cursor on, pass by pass, the cursors, and the last."""
    out, seen = [], []
    while True:
        before = cursor
        cursor, begin = advanced(path, cursor, limits)
        with open(path, "rb") as f:
            started = before.pending if before and not cursor.reset else None
            out += lines_between(f, begin, cursor.offset, started, limits.line_bytes)
        seen.append(cursor)
        if not cursor.limit:
            return out, seen, cursor


def test_random_files_in_passes(tmp_path):
    """Whatever the limits and however the file grows, the lines are those of the file."""
    rng = random.Random(1)
    for k in range(120):
        path, limits = tmp_path / f"{k}.jsonl", Limits(10, rng.choice([11, 15, 40, 10_000]), rng.choice([None, 1, 3]))
        whole, got, cursor = b"", [], None
        for _ in range(rng.randrange(1, 5)):
            whole += b"".join(bytes(rng.choices(b"ab\n", [5, 5, 2], k=rng.randrange(40))) for _ in range(rng.randrange(4)))
            path.write_bytes(whole)
            lines, seen, cursor = passes(path, cursor, limits)
            got += lines
            assert all(c.offset - (b.offset if b else 0) <= limits.pass_bytes for b, c in zip([None, *seen], seen, strict=False) if b)
        want, at = [], 0
        for line in whole.split(b"\n")[:-1]:
            want.append((at, at + len(line) + 1, line if len(line) <= 10 else None))
            at += len(line) + 1
        assert got == want
        rest = len(whole) - at
        assert (cursor.offset, cursor.pending) == ((len(whole), at) if rest > 10 else (at, None)) and cursor.generation == 0


def test_a_long_line_is_never_held(tmp_path):
    import tracemalloc

    path = tmp_path / "a.jsonl"
    with path.open("wb") as f:
        f.write(b'{"a":1}\n' + b"x" * 40_000_000 + b"\n" + b'{"b":2}\n')
    tracemalloc.start()
    lines, seen, _ = passes(path, limits=Limits(1_000_000, 8_000_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [line for *_, line in lines] == [b'{"a":1}', None, b'{"b":2}'] and lines[1][:2] == (8, 40_000_009)
    assert most < 12_000_000 and {c.limit for c in seen} == {"bytes", None} and len(seen) > 4


def test_limits_must_leave_room():
    for bad in ((10, 10), (0, 5), (5, 10, -1)):
        with pytest.raises(ValueError):
            Limits(*bad)


def test_reasons(tmp_path):
    path = tmp_path / "a.jsonl"
    text = b"".join(b'{"line": %d}\n' % i for i in range(1000))  # over two windows
    path.write_bytes(text)
    cursor, _ = advanced(path, None)

    def why(data, at=cursor):
        with path.open("r+b") as f:  # the same inode
            f.truncate(0)
            f.write(data)
        with path.open("rb") as f:
            return reset_reason(at, f)

    assert why(text) is None and why(text + b"more\n") is None
    assert why(text[:100]) == "size_below_offset"
    assert why(b"X" + text[1:] + b"more\n") == "head_digest_changed"
    assert why(text[:-9] + b"X" + text[-8:] + b"more\n") == "boundary_digest_changed"
    middle = Cursor(cursor.device, cursor.inode, 5, 0, *__import__("threadloom.streaming.cursor", fromlist=["digests"]).digests(path.open("rb"), 5))
    assert why(text[:-9] + b"X" + text[-8:] + b"more\n", middle) == "offset_not_at_line_boundary"
    again, begin = advanced(path, middle)
    assert (again.generation, again.reset, begin, again.pending) == (1, "offset_not_at_line_boundary", 0, None)
    other = tmp_path / "b"
    other.write_bytes(text)
    os.replace(other, path)
    with path.open("rb") as f:
        assert reset_reason(cursor, f) == "inode_changed"


def test_reasons_as_a_batch(spark):
    h, kind = "0" * 64, "named_struct('device', {}, 'inode', '2', 'offset', {}L, 'head', '{}', 'boundary', '{}', 'pending', cast({} as long))"
    seen = "named_struct('device', '1', 'inode', '2', 'size', 10L, 'head', '{}', 'boundary', '{}', 'at_line_boundary', {})"
    cases = [
        (kind.format("'1'", 5, h, h, "null"), seen.format(h, h, "true"), None), (kind.format("'1'", 5, h, h, "3"), seen.format(h, h, "false"), None),
        (kind.format("'9'", 50, "f" * 64, h, "null"), seen.format(h, h, "true"), "inode_changed"), (kind.format("'1'", 50, "f" * 64, h, "null"), seen.format(h, h, "true"), "size_below_offset"),
        (kind.format("'1'", 5, "f" * 64, "e" * 64, "null"), seen.format(h, h, "true"), "head_digest_changed"), (kind.format("'1'", 5, h, "e" * 64, "null"), seen.format(h, h, "false"), "boundary_digest_changed"),
        (kind.format("'1'", 5, h, h, "null"), seen.format(h, h, "false"), "offset_not_at_line_boundary"), (kind.format("null", 5, h, h, "null"), seen.format(h, h, "true"), "malformed_marker"),
        (kind.format("'1'", -1, h, h, "null"), seen.format(h, h, "true"), "malformed_marker"), (kind.format("'1'", 5, "xyz", h, "null"), seen.format(h, h, "true"), "malformed_marker"), (kind.format("'1'", 5, h, h, "6"), seen.format(h, h, "true"), "malformed_marker"),
    ]
    for marker, now, want in cases:
        assert spark.range(1).select(invalidation(F.expr(marker), F.expr(now)).alias("r")).first().r == want
    assert {c[2] for c in cases} == {None, "malformed_marker", *REASONS}


def test_stream_in_passes_and_generations(spark, tmp_path):
    """Small passes, a restart between them, a rewrite in place that keeps the first line, and a missing file."""
    from threadloom.streaming.tail import follow

    logs, state, out = tmp_path / "logs", tmp_path / "state", tmp_path / "out"
    logs.mkdir()
    file = logs / "s.jsonl"

    def run(times=1):
        for _ in range(times):
            stream = follow(spark, str(logs), most_bytes=30, pass_bytes=64)
            stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.read.parquet(str(out)).orderBy("generation", "byte_start").select("generation", "byte_start", "value", "status", "reset", "pass_limit").collect()]

    lines = ["first", "x" * 200, *(f"line {i}" for i in range(12))]
    file.write_text("\n".join(lines) + "\n")
    got = run(6)
    assert [v for _, _, v, *_ in got] == [None if len(v) > 30 else v for v in lines] and got[1][3] == "oversized"
    assert {g for g, *_ in got} == {0} and {p for *_, p in got} == {"bytes", None}
    whole = file.read_text()
    file.write_text("first\n" + "y" * 20 + "\n" + whole[30:] + "grown\n")  # the same inode and first line, and longer
    got = run(7)
    again = [r for r in got if r[0] == 1]
    assert [r[2] for r in again if r[2]][:2] == ["first", "y" * 20] and again[-1][2] == "grown" and again[0][4] == "head_digest_changed"
    os.rename(file, tmp_path / "away")
    assert run() == got
    os.rename(tmp_path / "away", file)
    assert run() == got
