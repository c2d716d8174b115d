"""Rule tables (data) and the predicates and decisions made of them (Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import EDGE_AFTER, EDGE_BEFORE, bound, trimmed

# Fixed values: (pattern, severity, message) of the command rules, in the order in which they are reported.
BASH_RULES = (
    (EDGE_BEFORE + "grep" + EDGE_AFTER + r"(?!.*\|)", "warning", "Use 'rg' (ripgrep) instead of 'grep' for better performance"),
    (EDGE_BEFORE + r"find\s+\S+\s+-name" + EDGE_AFTER, "warning", "Use 'rg --files | rg pattern' instead of 'find -name'"),
    (EDGE_BEFORE + r"rm\s+-rf?\s+[/~]", "error", "Dangerous recursive delete command detected"),
    (EDGE_BEFORE + r"sudo\s+rm" + EDGE_AFTER, "error", "Potentially dangerous sudo rm command"),
    (EDGE_BEFORE + r"chmod\s+777" + EDGE_AFTER, "warning", "chmod 777 creates security vulnerabilities"),
    (EDGE_BEFORE + r"mv\s+[^|]+\s+/dev/null", "warning", "Moving files to /dev/null effectively deletes them"),
    (r"\|\s*sh\s*\z", "warning", "Piping to sh can be dangerous with untrusted input"),
)
# Parts of dangerous commands.
DANGEROUS_COMMANDS = ("rm -rf", "sudo", "chmod 777", "dd", "mkfs")
# Folders of the system, patterns of sensitive paths, and extensions of files without text.
SYSTEM_FOLDERS = ("/etc/", "/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/")
SENSITIVE_PATHS = (r"/\.env", r"/\.git/", r"/\.ssh/", r"/\.aws/", r"/\.docker/", "/id_rsa", "/id_ed25519")
BINARY_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".pdf")
# Patterns of secrets in files.
FILE_SECRETS = (
    r"""(?i)(password|pwd)\s*[=:]\s*['"]\w+['"]""",
    r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*['"]\w+['"]""",
    r"""(?i)(secret|token)\s*[=:]\s*['"]\w+['"]""",
    r"(?i)(private[_-]?key|privatekey)\s*[=:]",
    "sk-[a-zA-Z0-9]{32,}",
    "ghp_[a-zA-Z0-9]{36}",
    "xoxb-[a-zA-Z0-9-]+",
)
# Fixed values: (pattern, message) of secrets in prompts.
PROMPT_SECRETS = (
    (r"""(?i)(?:password|pwd)\s*[=:]\s*["']?\w{3,}["']?""", "Password detected"),
    (r"""(?i)(?:api[_-]?key|apikey)\s*[=:]\s*["']?\w{10,}["']?""", "API key detected"),
    (r"""(?i)(?:secret|token)\s*[=:]\s*["']?\w{10,}["']?""", "Secret/token detected"),
    ("sk-[a-zA-Z0-9]{32,}", "OpenAI API key detected"),
    ("ghp_[a-zA-Z0-9]{36}", "GitHub token detected"),
    ("xoxb-[a-zA-Z0-9-]+", "Slack token detected"),
    ("AKIA[0-9A-Z]{16}", "AWS access key detected"),
    (r"(?i)(?:mysql|postgres|mongodb)://[^\s]+:[^\s]+@", "Database connection string detected"),
)
# Fixed values: (pattern, message) of attempts to inject instructions.
INJECTIONS = (
    (r"(?i)ignore\s+(?:previous|all|above)\s+(?:instructions?|prompts?|context)", "Instruction override attempt"),
    (r"(?i)you\s+are\s+now\s+(?:a|an)\s+\w+", "Role override attempt"),
    (r"(?i)(?:system|admin|root)\s*:\s*(?:ignore|override|disable)", "System override attempt"),
    (r"(?i)(?:execute|run|eval)\s*\(", "Code execution attempt"),
    (r"\$\{[^}]+\}", "Template injection pattern"),
    (r"(?i)<script[^>]*>", "Script injection attempt"),
)


def issues(text: Column, rules) -> Column:
    """The messages of the (pattern, message) rules that match, in order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(m)) for p, m in rules)), lambda x: x.isNotNull())


def bash_issues(command: Column) -> Column:
    """array<struct<severity, message, match>> of the command rules that match."""
    found = [F.when(command.rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"), F.regexp_extract(command, p, 0).alias("match"))) for p, s, m in BASH_RULES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def bash_valid(command: Column) -> Column:
    return ~F.exists(bash_issues(command), lambda x: x["severity"] == "error")


def any_match(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def dangerous_command(command: Column, parts=DANGEROUS_COMMANDS) -> Column:
    low, found = F.lower(command), F.lit(False)
    for part in parts:
        found = found | F.contains(low, F.lit(part))
    return found


def path_issues(path: Column) -> Column:
    system = F.lit(False)
    for folder in SYSTEM_FOLDERS:
        system = system | path.startswith(folder)
    checks = ((F.contains(path, F.lit("..")), "Path traversal detected (..)"), (system, "Path targets system directory"), (any_match(path, SENSITIVE_PATHS), "Path targets sensitive file or directory"))
    return F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull())


def glob_regex(glob: str) -> str:
    """An anchored regex of a path glob: ** crosses folders, * stays in one, and ? keeps its regex meaning."""
    out = ""
    for i, part in enumerate(glob.split("**")):
        out += ".*" * bool(i) + "".join("[^/]*" if c == "*" else f"\\{c}" if c in ".+^${}()|[]\\" else c for c in part)
    return f"^{out}$"


def protected_path(path: Column, patterns) -> Column:
    """Equal to a pattern, below it, or matched by it as a glob."""
    found = F.lit(False)
    for p in patterns:
        found = found | (path.rlike(glob_regex(p)) if "*" in p else (path == p) | path.startswith(p.rstrip("/") + "/"))
    return found


def contains_secrets(content: Column, path: Column) -> Column:
    binary = F.lit(False)
    for extension in BINARY_EXTENSIONS:
        binary = binary | F.lower(path).endswith(extension)
    return ~binary & any_match(content, FILE_SECRETS)


def prompt_structure(prompt: Column) -> Column:
    """struct(short, long_sentence, repeated: the words of over 3 characters that occur over 5 times, sorted).

    The words are sorted once: a word is repeated if the fifth after it is the same.
    """
    words = F.array_sort(F.filter(F.split(F.lower(prompt), r"\s+"), lambda w: F.length(w) > 3))
    repeated = bound(words, lambda ws: F.array_distinct(F.filter(F.zip_with(ws, F.slice(ws, 6, F.greatest(F.size(ws), F.lit(1))), lambda w, fifth: F.when(w == fifth, w)), lambda w: w.isNotNull())))
    return F.struct((F.length(trimmed(prompt)) < 10).alias("short"), F.exists(F.split(prompt, "[.!?]+"), lambda s: F.length(s) > 200).alias("long_sentence"), repeated.alias("repeated"))


def is_mcp_tool(name: Column) -> Column:
    parts = F.split(name, "__")
    return (F.size(parts) == 3) & name.startswith("mcp__") & (F.length(parts[1]) > 0) & (F.length(F.try_element_at(parts, F.lit(3))) > 0)
