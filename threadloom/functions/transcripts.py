"""What a session's transcript tells before it is compacted, and when a subagent stops: capped lists of matches, errors and warnings.

Texts in, columns out. Only the errors within the transcript's JSON, at any depth, take
Python: an Arrow UDF that goes through a line's nodes with a stack.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.decisions import IN_LINE, task_type, transcript_numbers
from threadloom.functions.text import bound, trimmed

#: A dot of these patterns: anything within a line.
DOT = IN_LINE[:-1]
# The patterns of each list, its caps, and the length that a task or an error must be below.
DECISIONS, DECISIONS_EACH, DECISIONS_ALL = ("decided to use", "chose to implement", f"will use{IN_LINE}instead of", "opted for", f"selected{IN_LINE}approach"), 3, 10
CHANGES, CHANGES_ALL = ("Write", "Edit", "MultiEdit"), 20
TASKS, TASK_LENGTH, TASKS_ALL = (r"TODO:?\s*", r"FIXME:?\s*", r"need to\s+", r"should\s+", r"will\s+"), 200, 15
ERRORS, ERROR_LENGTH, ERRORS_ALL = (r"Error:?\s*", r"Failed to\s+", r"Cannot\s+", r"TypeError:?\s*"), 300, 10
FILES, FILES_ALL = ("file_path", "path"), 25
# Prose errors and warnings.
PROSE_ERRORS = ("Error:", "Failed to", "Cannot ", "Permission denied", "File not found", "Command not found")
WARNINGS = ("Warning:", "Deprecated", "Should use", "Consider using")
NAMELESS = "Structured subagent error"


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _units(text: Column) -> Column:
    """UTF-16 units, as lengths are counted here."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def merged_unique(first: Column, second: Column) -> Column:
    """first, repeats and all, then what of second isn't in it, each once, in order."""
    return F.concat(first, F.array_except(second, first))


def key_decisions(transcript: Column) -> Column:
    each = [F.slice(_matches(transcript, f"(?i)({DOT}{{0,50}}{p}{DOT}{{0,100}})"), 1, DECISIONS_EACH) for p in DECISIONS]
    return F.slice(F.concat(*each), 1, DECISIONS_ALL)


def recent_changes(transcript: Column) -> Column:
    """Files written and edited, the last of a line."""
    return F.slice(F.array_distinct(F.concat(*(_matches(transcript, f'"tool_name":"{t}"{IN_LINE}"file_path":"([^"]+)"') for t in CHANGES))), 1, CHANGES_ALL)


def _lines_after(transcript: Column, starts: tuple[str, ...], below: int, most: int) -> Column:
    found = F.transform(F.concat(*(_matches(transcript, f"(?i){s}({DOT}+)") for s in starts)), trimmed)
    return F.slice(F.filter(found, lambda x: (x != "") & (_units(x) < below)), 1, most)


def pending_tasks(transcript: Column) -> Column:
    return _lines_after(transcript, TASKS, TASK_LENGTH, TASKS_ALL)


def unresolved_errors(transcript: Column) -> Column:
    return _lines_after(transcript, ERRORS, ERROR_LENGTH, ERRORS_ALL)


def important_files(transcript: Column) -> Column:
    found = F.concat(*(_matches(transcript, f'"{key}":"([^"]+)"') for key in FILES))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~(F.contains(x, F.lit("node_modules")) | F.contains(x, F.lit(".git"))))), 1, FILES_ALL)


def before_compaction(transcript: Column) -> Column:
    """struct(decisions, changes, tasks, errors, files); a null transcript is an empty one."""
    lists = lambda t: F.struct(key_decisions(t).alias("decisions"), recent_changes(t).alias("changes"), pending_tasks(t).alias("tasks"), unresolved_errors(t).alias("errors"), important_files(t).alias("files"))
    return bound(F.coalesce(transcript, F.lit("")), lists)


def _no_json(constant: str):
    raise ValueError(constant)


def _line_errors(line: str) -> list[str]:
    """A message for each node of the line's JSON that says is_error, and again for each that is of an error's type, from the top down."""
    try:
        left, out = [json.loads(line, parse_constant=_no_json)], []
    except (ValueError, RecursionError):
        return []
    while left:
        node = left.pop()
        if isinstance(node, list):
            left += reversed(node)
        elif isinstance(node, dict):
            said = next((node[k].strip() for k in ("message", "error", "content") if isinstance(node.get(k), str) and node[k].strip()), NAMELESS)
            out += [said] * ((node.get("is_error") is True) + (node.get("type") in ("error", "tool_error")))
            left += reversed(node.values())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def structured_errors(transcript: pd.Series) -> pd.Series:
    """The errors in a transcript's JSON lines; lines that are no JSON have none."""
    return transcript.map(lambda t: [e for line in (t or "").split("\n") for e in _line_errors(line)])


def prose_errors(text: Column) -> Column:
    found = F.concat(*(_matches(text, f"(?i){p}{DOT}+", 0) for p in PROSE_ERRORS))
    return F.filter(F.transform(found, trimmed), lambda x: x != "")


def warning_counts(text: Column) -> Column:
    def counted(word: str) -> Column:
        return bound(F.regexp_count(text, F.lit(word)), lambda n: F.when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(f" instances of '{word}'"))))

    return F.filter(F.array(*map(counted, WARNINGS)), lambda x: x.isNotNull())


def first_to_last_ms(transcript: Column) -> Column:
    """Milliseconds from the first time stamp to the last, if there are two and both are times."""

    def between(found: Column) -> Column:
        at = lambda i: F.unix_millis(F.try_to_timestamp(F.try_element_at(found, F.lit(i))))
        return F.when(F.size(found) >= 2, at(-1) - at(1))

    return bound(_matches(transcript, '"timestamp":"([^"]+)"'), between)


def subagent_analysis(own: Column, parent: Column, final: Column) -> Column:
    """struct(task_type, success, errors, warnings, output_size, tools_used, duration_ms) of a subagent's transcript, else its parent's, and its final message.

    A transcript that is null or blank doesn't count; without any the type is unknown.
    """
    some = lambda t: F.when(trimmed(t) != "", t)

    def told(x: Column) -> Column:
        t, said = x["t"], F.coalesce(trimmed(x["final"]), F.lit(""))
        none = F.expr("cast(array() as array<string>)")
        of = lambda value, empty: F.when(t.isNotNull(), value).otherwise(empty)
        spoken = lambda value: F.when(said != "", value).otherwise(none)
        size = F.greatest(of(_units(t), F.lit(0).cast("long")), _units(said))
        errors = merged_unique(F.coalesce(x["errors"], none), spoken(prose_errors(said)))
        result = lambda errors: F.struct(
            of(task_type(t), F.lit("unknown")).alias("task_type"), (F.size(errors) == 0).alias("success"), errors.alias("errors"), merged_unique(of(warning_counts(t), none), spoken(warning_counts(said))).alias("warnings"),
            size.alias("output_size"), of(transcript_numbers(t)["tools"], none).alias("tools_used"), of(first_to_last_ms(t), F.lit(None)).alias("duration_ms"),
        )
        return bound(errors, result)

    chosen = F.coalesce(some(own), some(parent))
    return bound(F.struct(chosen.alias("t"), final.alias("final"), structured_errors(chosen).alias("errors")), told)
