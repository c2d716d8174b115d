"""Scalar functions on text: Column in, Column out, no Python in the data path."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trims and \s take away, as a regex class body.
SPACE = r"\s\x{FEFF}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Edges of ASCII words; Java's \b would count accented letters.
EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# The names of keys whose values are secrets, and what a redacted value looks like.
KEY = r"(?:[A-Za-z][A-Za-z0-9]*[_-]){0,12}(?:api[_-]?key|apikey|token|secret|password|passwd|pwd|access[_-]?key|authorization|bearer|cookie|session|credential)(?:[_-][A-Za-z0-9]+){0,12}"
PLACEHOLDER = r"\[REDACTED:[A-Z0-9_]+\]"
#: What any assignment to such a key contains; looking for it first spares most texts the passes.
ASSIGNED = r"""(?i)(?:api[_-]?key|token|secret|password|passwd|pwd|access[_-]?key|authorization|bearer|cookie|session|credential)(?:[_-][A-Za-z0-9]+){0,12}"?\s*[:=]"""
BENIGN = r"^(?:true|false|-?\d+(?:\.\d+)?)$"
# Patterns of stand-alone tokens, in the order in which they are replaced, and their labels.
TOKENS = (
    (EDGE_BEFORE + r"Bearer\s+[A-Za-z0-9._~+/=-]{8,}(?<=[A-Za-z0-9_])" + EDGE_AFTER, "Bearer [REDACTED:AUTHORIZATION]"),
    (EDGE_BEFORE + r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", "[REDACTED:OPENAI_API_KEY]"),
    (EDGE_BEFORE + r"ghp_[A-Za-z0-9]{36,}" + EDGE_AFTER, "[REDACTED:GITHUB_TOKEN]"),
    (EDGE_BEFORE + r"gh[oprsu]_[A-Za-z0-9]{36,}" + EDGE_AFTER, "[REDACTED:GITHUB_TOKEN]"),
    (EDGE_BEFORE + r"github_pat_[A-Za-z0-9_]{60,}" + EDGE_AFTER, "[REDACTED:GITHUB_TOKEN]"),
    (EDGE_BEFORE + r"glpat-[A-Za-z0-9_-]{20,}", "[REDACTED:GITLAB_TOKEN]"),
    (EDGE_BEFORE + r"AIza[A-Za-z0-9_-]{35}(?<=[A-Za-z0-9_])" + EDGE_AFTER, "[REDACTED:GOOGLE_API_KEY]"),
    (EDGE_BEFORE + r"xox[baprs]-[A-Za-z0-9-]{10,}(?<=[A-Za-z0-9_])" + EDGE_AFTER, "[REDACTED:SLACK_TOKEN]"),
    (EDGE_BEFORE + r"AKIA[0-9A-Z]{16}" + EDGE_AFTER, "[REDACTED:AWS_ACCESS_KEY_ID]"),
)
#: Each token holds one of these; looking for them first spares most texts the passes.
TOKEN_PARTS = ("Bearer", "sk-", "gh", "glpat-", "AIza", "xox", "AKIA")
# Tags with which text that a program wrote begins.
NOISE_TAGS = ("<task-notification>", "<system-reminder>", "<local-command-stdout>", "<local-command-caveat>", "<command-name>")


def trimmed(text: Column) -> Column:
    """text without white space, Unicode's included, at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_noise(text: Column) -> Column:
    start = trimmed(text)
    found = F.lit(False)
    for tag in NOISE_TAGS:
        found = found | start.startswith(tag)
    return found


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def truncated_lines(text: Column, most: int = 200) -> Column:
    lines = F.split(text, "\n", -1)
    note = F.concat(F.lit("\n\n[..."), (F.size(lines) - most).cast("string"), F.lit(" more lines truncated...]"))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), note)).otherwise(text)


def redaction_label(key: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.upper(key), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("[REDACTED:"), name, F.lit("]"))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _rewritten(text: Column, pattern: str, rewrite) -> Column:
    """text with each match replaced by rewrite(match): gaps and matches are zipped back together."""

    def pieces(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), rewrite)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    return bound(text, pieces)


def _assignments(text: Column, quote: str, value: str) -> Column:
    """text with the values of secret keys replaced, where they stand in quote."""
    pattern = rf"(?i){EDGE_BEFORE}({KEY}){EDGE_AFTER}(\s*[:=]\s*){quote}({value}){quote}"

    def replace(m: Column) -> Column:
        key, sep, own = (F.regexp_extract(m, pattern, i) for i in (1, 2, 3))
        new = F.when(own.rlike(f"^{PLACEHOLDER}$"), own).otherwise(redaction_label(key))
        return F.when(own.rlike(BENIGN), m).otherwise(F.concat(key, sep, F.lit(quote), new, F.lit(quote)))

    return _rewritten(text, pattern, replace)


def _assigned(text: Column) -> Column:
    """text with the values of secret keys replaced: in JSON, in quotes, and bare."""
    value = r"""[^\s"'`,}\]]+"""
    json = rf"""(?i)("({KEY})"\s*:\s*")([^"\n]*)(")"""
    out = _rewritten(text, json, lambda m: F.concat(F.regexp_extract(m, json, 1), redaction_label(F.regexp_extract(m, json, 2)), F.lit('"')))

    for quote in ('"', "'"):
        out = _assignments(out, quote, rf"{PLACEHOLDER}|[^\"'\n]*")
    out = _assignments(out, "", f"{PLACEHOLDER}|{value}")
    return out


def redacted(text: Column) -> Column:
    """text with secrets replaced by labelled placeholders; values that are numbers or booleans stay, and reruns change nothing."""
    url = r"(?i)" + EDGE_BEFORE + r"([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@"
    out = bound(text, lambda t: F.when(F.contains(t, F.lit("://")), F.regexp_replace(t, url, "$1[REDACTED:URL_CREDENTIALS]@")).otherwise(t))
    value = r"""[^\s"'`,}\]]+"""
    out = F.regexp_replace(out, r"(?i)(" + EDGE_BEFORE + r"(?:authorization|proxy-authorization)" + EDGE_AFTER + r"""\s*[:=]\s*)(["']?)(?:bearer\s+""" + value + r"|basic\s+" + value + "|" + PLACEHOLDER + "|" + value + r")(\2)", "$1$2[REDACTED:AUTHORIZATION]$3")

    out = bound(out, lambda t: F.when(t.rlike(ASSIGNED), _assigned(t)).otherwise(t))

    def tokens(t: Column) -> Column:
        for pattern, label in TOKENS:
            t = F.regexp_replace(t, pattern, label)
        return t

    some = lambda t: reduce(or_, (F.contains(t, F.lit(part)) for part in TOKEN_PARTS))
    return bound(out, lambda t: F.when(some(t), tokens(t)).otherwise(t))


def retained(text: Column, most: int = 200) -> Column:
    """A tool result as it is kept: struct(content, truncated, original_line_count); lines are counted before redaction."""
    n = line_count(text)
    content = bound(redacted(text), lambda t: F.when(n > most, truncated_lines(t, most)).otherwise(t))
    return F.struct(content.alias("content"), (n > most).alias("truncated"), n.cast("long").alias("original_line_count"))


def image_placeholder(source: Column) -> Column:
    """source: the image's JSON object as text."""
    kind = F.get_json_object(source, "$.media_type")
    return F.when(kind.rlike(r"^[A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+$"), F.concat(F.lit("[Image: "), kind, F.lit("]"))).otherwise(F.lit("[Image]"))


def duration_label(ms: Column) -> Column:
    """Seconds under a minute, minutes under an hour, else hours and minutes; halves round up."""
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    minutes = rounded(ms / 60_000)
    return (
        F.when(ms < 60_000, F.concat(rounded(ms / 1000).cast("string"), F.lit("s")))
        .when(ms < 3_600_000, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit("h "), rounded((ms % 3_600_000) / 60_000).cast("string"), F.lit("m")))
    )


def slug(text: Column, most: int = 40) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(dashed, 1, most)


def epoch_ms(x: Column) -> Column:
    """Milliseconds from a number of seconds or of milliseconds, told apart by size."""
    return F.when(F.abs(x) < 1e11, x * 1000).otherwise(x)


def record_id(session: Column, source: Column, uuid: Column, begin: Column, end: Column, line: Column) -> Column:
    by_place = F.concat_ws(":", session, source, begin.cast("string"), end.cast("string"), F.sha2(trimmed(line), 256))
    return F.when(F.coalesce(uuid, F.lit("")) != "", F.concat_ws(":", session, source, uuid)).otherwise(by_place)


def canonical_json_sha256(json: Column) -> Column:
    """The hash of a JSON text with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.try_parse_json(json)), 256)


# Argument names that a tool's summary shows, in the order of preference, and the longest text kept (0: all).
TOOL_ARGUMENTS = {
    "Read": (("file_path",), 0), "Write": (("file_path",), 0), "Edit": (("file_path",), 0), "MultiEdit": (("file_path",), 0), "NotebookEdit": (("notebook_path", "file_path"), 0),
    "Bash": (("command",), 80), "Glob": (("pattern",), 0), "Grep": (("pattern",), 0), "WebFetch": (("url",), 0), "WebSearch": (("query",), 60),
    "Agent": (("description", "subagent_type"), 60), "TaskCreate": (("subject", "description"), 60), "TaskGet": (("taskId",), 0), "TaskStop": (("taskId",), 0), "TaskOutput": (("taskId",), 0),
    "ToolSearch": (("query",), 60), "Monitor": (("command", "taskId"), 60), "RemoteTrigger": (("agentId", "name"), 60), "PushNotification": (("message", "title"), 60),
    "EnterWorktree": (("name", "path"), 0), "CronCreate": (("name", "schedule"), 60), "CronDelete": (("id", "name"), 0), "LSP": (("method", "command"), 60),
    "ListMcpResourcesTool": (("server",), 0), "ReadMcpResourceTool": (("uri", "server"), 0),
}
PLAIN_TOOLS = ("TaskList", "EnterPlanMode", "ExitWorktree", "CronList")


def plan_summary(plan: Column) -> Column:
    lines = F.transform(F.split(plan, "\r?\n"), trimmed)
    heading = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+\S")), F.lit(1))
    text = F.coalesce(F.regexp_replace(heading, r"^#{1,6}\s+", ""), trimmed(plan))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("?")).otherwise(truncated(text, 60))


def tool_summary(name: Column, arguments: Column) -> Column:
    """A tool call in one line. arguments: the call's JSON object as text."""
    arg = lambda key: F.get_json_object(arguments, f"$.{key}")
    call = lambda label, inner: F.concat(label, F.lit("("), inner, F.lit(")"))
    entries = F.map_entries(F.from_json(arguments, "map<string,variant>"))
    text = F.try_element_at(F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING"), F.lit(1))
    generic = F.coalesce(F.concat(text["key"], F.lit(": "), truncated(F.try_variant_get(text["value"], "$", "string"), 50)), F.lit(""))
    out = F.when(F.lit(False), F.lit(""))
    for tool, (keys, most) in TOOL_ARGUMENTS.items():
        shown = F.coalesce(*map(arg, keys), F.lit("?"))
        out = out.when(name == tool, call(F.lit(tool), truncated(shown, most) if most else shown))
    for tool in PLAIN_TOOLS:
        out = out.when(name == tool, F.lit(f"{tool}()"))
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    skill = F.coalesce(arg("skill"), F.lit("?"))
    out = out.when(name == "Skill", F.when(some(arg("args")), call(F.lit("Skill"), F.concat(skill, F.lit(": "), truncated(arg("args"), 40)))).otherwise(call(F.lit("Skill"), skill)))
    task = F.when(arg("taskId").isNull(), F.lit("?")).when(arg("status").isNull(), arg("taskId")).otherwise(F.concat_ws(": ", arg("taskId"), arg("status")))
    out = out.when(name == "TaskUpdate", call(F.lit("TaskUpdate"), task))
    out = out.when(name == "ExitPlanMode", F.concat(F.lit("plan: "), F.coalesce(plan_summary(arg("plan")), F.lit("?"))))
    out = out.when(name == "AskUserQuestion", call(F.lit("AskUserQuestion"), F.coalesce(truncated(F.get_json_object(arguments, "$.questions[0].question"), 60), F.lit("?"))))
    delay = F.coalesce(F.concat(arg("delaySeconds"), F.lit("s")), F.lit("?"))
    out = out.when(name == "ScheduleWakeup", call(F.lit("ScheduleWakeup"), F.concat_ws(": ", delay, truncated(arg("reason"), 40))))
    mcp = "^mcp__(.*?)__(.*)$"
    out = out.when(name.rlike(mcp), call(F.concat(F.lit("mcp:"), F.regexp_extract(name, mcp, 1), F.lit("."), F.regexp_extract(name, mcp, 2)), generic))
    return out.otherwise(call(name, generic))


def public_json(json: Column, placeholder: str = "[REDACTED:RAW_TRANSCRIPT_VALUE]") -> Column:
    """A JSON text whose string values, at any depth, are the placeholder; keys, numbers, booleans and nulls stay. Null if it isn't JSON.

    Between the quotes that are not escaped, every second piece is a string, and one that a
    colon follows is a key. Two control characters, which JSON text never holds, stand for the
    escapes meanwhile.
    """
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))

    def joined(pieces: Column) -> Column:
        key = lambda i: F.coalesce(F.try_element_at(pieces, i + 2).rlike(r"^\s*:"), F.lit(False))
        kept = F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & ~key(i), F.lit(placeholder)).otherwise(x))
        return F.array_join(kept, '"')

    back = F.replace(F.replace(bound(F.split(plain, '"', -1), joined), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(F.try_parse_json(json).isNotNull(), back)
