"""Decisions and classes of single rows: commands, prompts, notifications, tasks, failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.functions.text import trimmed

# Beginnings and patterns of commands that only look.
SAFE_COMMANDS = (
    "ls", "cat", "head", "tail", "less", "more", "file", "stat", "wc", "du", "find", "ps", "top", "jobs", "pgrep", "uname", "whoami", "pwd", "date", "uptime",
    "node --version", "npm --version", "git --version", "git status", "git log", "git diff", "git branch", "git show", "ping", "nslookup", "dig", "npm list", "npm outdated", "npm audit",
)
SAFE_PATTERNS = (r"^echo\s+", r"^which\s+", r"^type\s+", r"^grep\s+.*\s+<\s+", r"^[a-zA-Z0-9_-]+\s+--help\z", r"^[a-zA-Z0-9_-]+\s+--version\z")
# Fixed values: (pattern, hint) of what standard error says, first match counts.
FAILURES = (
    ("(?i)command not found", "Command not found. Check if the tool is installed and in your PATH."),
    ("(?i)permission denied", "Permission denied. You may need to use sudo or check file permissions."),
    ("(?i)no such file or directory", "File or directory not found. Check the path and ensure the file exists."),
    ("(?i)npm.*ENOENT", 'npm error: Try running "npm install" to install dependencies.'),
    ("(?i)git.*not a git repository", 'Not a git repository. Run "git init" to initialize a git repository.'),
    ("(?i)typescript.*error", "TypeScript compilation error. Check the TypeScript code for syntax errors."),
)
# Classes of notification types, and words that tell a class where no type is given.
NOTIFICATION_TYPES = {
    "permission_prompt": "permission", "idle_prompt": "waiting", "elicitation_dialog": "waiting", "elicitation_response": "waiting", "agent_needs_input": "waiting",
    "auth_success": "info", "elicitation_complete": "info", "agent_completed": "info",
}
NOTIFICATION_WORDS = (("permission|approve", "permission"), ("waiting|input", "waiting"), ("error|failed", "error"))
# Tools that tell a task's type, first match counts, and what is critical in each type.
TASK_TOOLS = (("Write|Edit", "file-modification"), ("Bash", "command-execution"), ("WebFetch|WebSearch", "web-research"), ("Read|Grep", "code-analysis"))
CRITICAL = {
    "file-modification": ("permission denied", "file not found", "syntax error"),
    "command-execution": ("command not found", "permission denied", "segmentation fault"),
    "web-research": ("timeout", "network error", "403 forbidden", "404 not found"),
}
ERROR_WORDS = ("Error:", "Failed to", "Cannot", '"error":')


def safe_command(command: Column) -> Column:
    found = rules.any_match(command, SAFE_PATTERNS)
    for start in SAFE_COMMANDS:
        found = found | command.startswith(start)
    return found


def bash_decision(command: Column) -> Column:
    """deny on an error, ask on a warning, allow what only looks, else pass."""
    own = trimmed(command)
    has = lambda severity: F.exists(rules.bash_issues(own), lambda x: x["severity"] == severity)
    return F.when(has("error"), "deny").when(has("warning"), "ask").when(safe_command(own), "allow").otherwise("pass")


def prompt_decision(prompt: Column, most: int = 10_000, block_injection: bool = False) -> Column:
    """struct(decision, reasons): too long and secrets block, injections and structure warn."""
    secrets, injections, shape = rules.issues(prompt, rules.PROMPT_SECRETS), rules.issues(prompt, rules.INJECTIONS), rules.prompt_structure(prompt)
    long = F.length(prompt) > most
    blocked = long | (F.size(secrets) > 0) | (F.lit(block_injection) & (F.size(injections) > 0))
    warned = (F.size(injections) > 0) | shape["short"] | shape["long_sentence"] | (F.size(shape["repeated"]) > 0)
    return F.struct(F.when(blocked, "block").when(warned, "warn").otherwise("pass").alias("decision"), F.when(long, F.array(F.lit("too long"))).otherwise(F.concat(secrets, injections)).alias("reasons"))


def failure_hint(stderr: Column) -> Column:
    return F.try_element_at(rules.issues(stderr, FAILURES), F.lit(1))


def notification_class(message: Column, kind: Column) -> Column:
    by_word = F.when(F.lit(False), F.lit(""))
    for words, name in NOTIFICATION_WORDS:
        by_word = by_word.when(F.lower(message).rlike(words), name)
    types = F.create_map(*(F.lit(x) for pair in NOTIFICATION_TYPES.items() for x in pair))
    return F.coalesce(types[kind], by_word.otherwise("info"))


def notification_priority(name: Column) -> Column:
    return F.when(name.isin("permission", "error"), "high").when(name == "waiting", "normal").otherwise("low")


def task_type(transcript: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for tools, name in TASK_TOOLS:
        out = out.when(transcript.rlike(f'"tool_name":"({tools})"'), name)
    return out.otherwise("general-task")


def critical_errors(task: Column, errors: Column) -> Column:
    """The patterns critical for the task's type that its errors, joined, match."""
    text = F.array_join(errors, " ")
    found = [F.when((task == name) & text.rlike(f"(?i){p}"), F.lit(f"Critical error detected: {p}")) for name, patterns in CRITICAL.items() for p in patterns]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def transcript_numbers(transcript: Column) -> Column:
    """struct(commands, errors, tools, modified files, first timestamp) of a transcript's text, as literal patterns find them."""
    tools = F.array_distinct(F.regexp_extract_all(transcript, F.lit('"tool_name":"([^"]+)"'), F.lit(1)))
    files = F.concat(*(F.regexp_extract_all(transcript, F.lit(f'"tool_name":"{t}".*?"file_path":"([^"]+)"'), F.lit(1)) for t in ("Write", "Edit", "MultiEdit")))
    errors = sum((F.regexp_count(transcript, F.lit(w)) for w in ERROR_WORDS), F.lit(0))
    return F.struct(
        F.regexp_count(transcript, F.lit('"tool_name":"Bash"')).alias("commands"), errors.alias("errors"), tools.alias("tools"),
        F.array_distinct(F.filter(files, lambda f: ~F.contains(f, F.lit("node_modules")))).alias("files"), F.nullif(F.regexp_extract(transcript, '"timestamp":"([^"]+)"', 1), F.lit("")).alias("start_time"),
    )


# Commands that may take long, and the seconds that a script's name gives (the name, or it before a colon; first match counts).
LONG_RUNNING = (
    "check:fast", "check", "check:ci", r"fix:file\s+--\s+.+", "typecheck:all", "lint:focus", "lint:dev", "lint", "lint:classify", "lint:session:.+", "sync", "validate:.+",
)
LONG_CODEGEN = r"^npx convex codegen(\s+--typecheck[=-](?:disable|enable))?\z"
SCRIPT_SECONDS = (
    ("check:fast", 180), ("check", 180), ("fix:file", 120), ("typecheck:all", 120), ("lint:focus", 90), ("lint:dev", 90), ("lint", 120), ("lint:classify", 90), ("lint:session", 90), ("sync", 120), ("codegen", 60),
)
# What a task's text, a URL's host and a tool's values should not hold.
CONCERNS = ("delete.*all", "remove.*everything", "format.*drive", "system.*admin")
INTERNAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "10.", "192.168.", "172.")
RISKY_VALUES = (r"rm\s+-rf", "sudo.*rm", "chmod.*777", "passwd.*root")
#: What a dot stands for in these patterns: anything within a line.
IN_LINE = r"[^\n\r\x{2028}\x{2029}]*"


def sanitized_command(command: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(command, "[`$()]", ""), ";+", ";"))


def long_running(command: Column) -> Column:
    return rules.any_match(trimmed(command), [*(rf"^npm run {script}\z" for script in LONG_RUNNING), LONG_CODEGEN])


def command_seconds(command: Column) -> Column:
    """The time that a command is given, by the script it runs."""
    script = F.regexp_extract(command, r"npm run ([\w:]+)", 1)
    out = F.when(F.lit(False), F.lit(0))
    for name, seconds in SCRIPT_SECONDS:
        out = out.when((script == name) | script.startswith(f"{name}:"), seconds)
    return out.when(F.contains(script, F.lit("validate")) | F.contains(script, F.lit("check")), 180).otherwise(120)


def suppresses_lint(content: Column) -> Column:
    return content.rlike(r"(?i)(//|/\*)\s*eslint-disable")


def concerning_task(text: Column) -> Column:
    return rules.any_match(text, [f"(?i){p.replace('.*', IN_LINE)}" for p in CONCERNS])


def internal_url(url: Column) -> Column:
    """The host holds a name or the beginning of an address of an own network; an invalid URL has no host."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.exists(F.array(*map(F.lit, INTERNAL_HOSTS)), lambda part: F.contains(host, part)), F.lit(False))


def risky_values(values: Column) -> Column:
    """values: a tool's string arguments, joined."""
    return rules.any_match(values, [p.replace(".*", IN_LINE) for p in RISKY_VALUES])


def instruction_issues(text: Column) -> Column:
    checks = (
        (F.contains(text, F.lit("ignore")) | F.contains(text, F.lit("delete all")), "aggressive"),
        (F.length(text) > 1000, "long"),
        (F.length(text) < 10, "brief"),
    )
    return F.filter(F.array(*(F.when(found, F.lit(name)) for found, name in checks)), lambda x: x.isNotNull())


def syntax_issues(content: Column, path: Column) -> Column:
    """What a file's text does not close: brackets and unescaped quotes of scripts, values of JSON."""
    count = lambda pattern: F.regexp_count(content, F.lit(pattern))
    script = path.rlike(r"\.(ts|tsx|js|jsx)\z")
    checks = (
        (path.endswith(".json") & F.try_parse_json(content).isNull(), "json"),
        (script & (count(r"[{\[]") != count(r"[}\]]")), "brackets"),
        (script & (count(r"(?<!\\)'") % 2 != 0), "single quotes"),
        (script & (count(r'(?<!\\)"') % 2 != 0), "double quotes"),
    )
    return F.filter(F.array(*(F.when(found, F.lit(name)) for found, name in checks)), lambda x: x.isNotNull())
