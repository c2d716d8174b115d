"""How far a growing file was read, and whether what was read is still there.

A cursor is what a stream's offset holds for a file. It names the file (device, inode), the
byte after the last line read, the digests of the first and the last bytes before it, and
the start of an oversized line that is being thrown away. A file that no longer fits its
cursor is read again from its start, as its next generation, for the first of ``REASONS``
that holds. All reads are bounded: two windows for the digests, and one pass's bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a digest's window, and the limits of a line and of a pass.
WINDOW = 4096
LINE_BYTES, PASS_BYTES, PASS_LINES = 16 * 1024 * 1024, 32 * 1024 * 1024, 10_000
#: In the order in which they are told.
REASONS = ("inode_changed", "size_below_offset", "head_digest_changed", "boundary_digest_changed", "offset_not_at_line_boundary")
CHUNK = 1 << 20


@dataclass(frozen=True)
class Cursor:
    device: int
    inode: int
    offset: int = 0
    generation: int = 0
    head: str = ""
    boundary: str = ""
    #: The start of an oversized line whose end is still to come.
    pending: int | None = None
    #: What the file was like when it was last looked at.
    size: int = 0
    modified: int = 0
    #: What ended the last pass (null: nothing is left), and why it began at the start again.
    limit: str | None = None
    reset: str | None = None

    @classmethod
    def of(cls, known: dict) -> Cursor:
        return cls(**known)

    def saved(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Limits:
    line_bytes: int = LINE_BYTES
    pass_bytes: int = PASS_BYTES
    #: None: any number. Counting needs the pass's bytes to be read where it is planned.
    pass_lines: int | None = None

    def __post_init__(self):
        if min(self.line_bytes, self.pass_bytes, self.pass_lines or 1) < 1 or self.pass_bytes < self.line_bytes + 1:
            raise ValueError("limits must be positive, and a pass longer than the longest line")


def digests(f: BinaryIO, offset: int) -> tuple[str, str]:
    """SHA-256 of the first and of the last ``WINDOW`` bytes before offset."""
    out = []
    for start in (0, max(0, offset - WINDOW)):
        f.seek(start)
        out.append(hashlib.sha256(f.read(min(offset, WINDOW))).hexdigest())
    return out[0], out[1]


def reset_reason(cursor: Cursor, f: BinaryIO) -> str | None:
    """Why the open file must be read from its start again, or None."""
    now = os.fstat(f.fileno())
    if (cursor.device, cursor.inode) != (now.st_dev, now.st_ino):
        return "inode_changed"
    if now.st_size < cursor.offset:
        return "size_below_offset"
    if cursor.offset:
        head, boundary = digests(f, cursor.offset)
        if head != cursor.head:
            return "head_digest_changed"
        if boundary != cursor.boundary:
            return "boundary_digest_changed"
        f.seek(cursor.offset - 1)
        if cursor.pending is None and f.read(1) != b"\n":
            return "offset_not_at_line_boundary"
    return None


def last_newline(f: BinaryIO, begin: int, end: int) -> int | None:
    """Where the last newline of [begin, end) is; reads from the end."""
    while end > begin:
        start = max(begin, end - CHUNK)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at
        end = start
    return None


def nth_newline(f: BinaryIO, begin: int, end: int, n: int) -> int | None:
    """Where the n-th newline of [begin, end) is, if there are so many."""
    f.seek(begin)
    while begin < end:
        data = f.read(min(CHUNK, end - begin))
        if not data:
            return None
        found = data.count(b"\n")
        if found >= n:
            at = -1
            for _ in range(n):
                at = data.find(b"\n", at + 1)
            return begin + at
        n, begin = n - found, begin + len(data)
    return None


def advanced(path: str, cursor: Cursor | None, limits: Limits = Limits()) -> tuple[Cursor, int]:
    """The cursor after one pass over what path has now, and the byte at which the pass begins.

    A pass ends after a line, but within a line that is longer than a line may be: what was
    read of it is thrown away, and ``pending`` says where it began. A last line without its
    newline waits. Of a limit, ``limit`` says which: bytes or lines.
    """
    with open(path, "rb") as f:
        now = os.fstat(f.fileno())
        reason = None if cursor is None else reset_reason(cursor, f)
        if cursor is None or reason:
            cursor = Cursor(now.st_dev, now.st_ino, generation=0 if cursor is None else cursor.generation + 1)
        begin = cursor.offset
        most = min(now.st_size, begin + limits.pass_bytes)
        limit, pending, end = None, cursor.pending, begin
        newline = last_newline(f, begin, most)
        if newline is not None:
            end, pending = newline + 1, None
            if limits.pass_lines and (last := nth_newline(f, begin, end, limits.pass_lines)) is not None and last + 1 < end:
                end, limit = last + 1, "lines"
        started = end if pending is None else pending
        if limit is None and most - started > limits.line_bytes:
            end, pending = most, started
        if limit is None and most < now.st_size:
            limit = "bytes"
        head, boundary = digests(f, end)
        return replace(cursor, offset=end, head=head, boundary=boundary, pending=pending, size=now.st_size, modified=now.st_mtime_ns, limit=limit, reset=reason), begin


def lines_between(f: BinaryIO, begin: int, end: int, started: int | None, line_bytes: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, line) of the lines that end in [begin, end); None for an oversized one, which is never held whole.

    started: where the line began that begins before ``begin``, which is oversized.
    """
    at, over, held, start = begin, started is not None, b"", begin if started is None else started
    f.seek(begin)
    while at < end:
        part = f.readline(min(CHUNK, end - at))
        if not part:
            return
        at += len(part)
        ended = part.endswith(b"\n")
        over = over or len(held) + len(part) - ended > line_bytes
        held = b"" if over else held + part
        if ended:
            yield start, at, None if over else held[:-1]
            start, over, held = at, False, b""


def invalidation(marker: Column, seen: Column) -> Column:
    """The first reason for which a marker must be discarded, as a column of a batch; null if it holds.

    marker: struct(device, inode, offset, head, boundary, pending); seen: struct(device, inode,
    size, head, boundary, at_line_boundary) of the file as it is. Markers without a field, or
    with an offset or a start that can't be, are ``malformed_marker``.
    """
    named = F.coalesce(marker["device"], F.lit("")) != ""
    named &= F.coalesce(marker["inode"], F.lit("")) != ""
    fits = marker.isNotNull() & named & (marker["offset"] >= 0) & marker["head"].rlike("^[0-9a-f]{64}$") & marker["boundary"].rlike("^[0-9a-f]{64}$")
    fits &= marker["pending"].isNull() | ((marker["pending"] >= 0) & (marker["pending"] <= marker["offset"]))
    tests = {
        "inode_changed": (marker["device"] != seen["device"]) | (marker["inode"] != seen["inode"]),
        "size_below_offset": seen["size"] < marker["offset"],
        "head_digest_changed": marker["head"] != seen["head"],
        "boundary_digest_changed": marker["boundary"] != seen["boundary"],
        "offset_not_at_line_boundary": ~seen["at_line_boundary"] & marker["pending"].isNull(),
    }
    out = F.when(~F.coalesce(fits, F.lit(False)), "malformed_marker")
    for reason in REASONS:
        out = out.when(tests[reason], reason)
    return out
