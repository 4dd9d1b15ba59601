"""Text, identity and vocabulary column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import c

# Wording that names a failure, that negates one, the shell wrapper's first line and
# the phrases a declined call starts with.
FAILURE_LINE = r"(?i)\b(?:fail(?:ed|ure|ing)?|errors?|exceptions?)\b"
NEGATED_LINE = (r"(?i)\b(?:no|0|zero)\s+(?:errors?|failures?)\b|\bwithout\s+(?:errors?|failures?)\b"
                r"|\b0\s+failed\b|\berrors?:\s*0\b")
EXIT_CODE_LINE = r"(?i)^\s*(?:Error:\s*)?Exit code (\d+)\s*$"
USER_REJECTION = (r"(?i)^\s*(?:Error:\s*)?(?:The user doesn't want to (?:proceed|take this action)"
                  r"|\[Request interrupted by user|The user rejected permission|Tool execution aborted)")

# Shapes of local file paths.
PATH_SHAPES = (r"(?i)(file://[^\s\"'`<>]*|(?:/users/|/home/)[^\s\"'`<>]+|[a-z]:[\\/]+users[\\/]+[^\s\"'`<>]+"
               r"|(?:\\\\\\\\\?\\\\|\\\\\?\\|//\?/)[^\s\"'`<>]*"
               r"|\\\\\\\\[a-z0-9._$-]+\\\\[a-z0-9._$-]+|\\\\[a-z0-9._$-]+\\[a-z0-9._$-]+)")

# First matching pattern decides the activity of a script name segment.
SCRIPT_PATTERNS = [
    ("^(test|tests|e2e|spec|unit|integration)", "test"),
    ("^(build|compile|bundle|assemble|dist)", "build"),
    ("^(lint|format|fmt|typecheck|type-check|types-check|check|verify|validate|prettier|eslint|tsc)", "check"),
    ("^(db|migrat|seed|prisma|drizzle)", "data"),
    ("^(dev|start|serve|preview|watch)$", "run"),
]

# Tool -> (target kind, input field), per source.
TARGETS = {
    "claude-code": {"Read": ("file-read", "file_path"), "Edit": ("file-write", "file_path"),
                    "MultiEdit": ("file-write", "file_path"), "Write": ("file-write", "file_path"),
                    "NotebookEdit": ("file-write", "notebook_path"), "Bash": ("command", "command"),
                    "PowerShell": ("command", "command")},
    "opencode": {"read": ("file-read", "filePath"), "edit": ("file-write", "filePath"),
                 "write": ("file-write", "filePath"), "bash": ("command", "command")},
}

SHELL_TOOLS = ["Bash", "PowerShell", "bash"]
EDIT_TOOLS = ["Edit", "MultiEdit", "Write", "NotebookEdit", "edit", "write", "patch", "apply_patch"]


def lines_of(text: Column | str) -> Column:
    return F.split(c(text), "\n")


def _nonblank(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s", " ")) != ""


def error_preview(text: Column | str, limit: int = 200) -> Column:
    """Text from the last line naming a failure, else the first line that is not an exit code."""
    ls = lines_of(text)
    idx = F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(idx, lambda r: _nonblank(r["x"]))
    bad = F.filter(full, lambda r: r["x"].rlike(FAILURE_LINE) & ~r["x"].rlike(NEGATED_LINE))
    plain = F.filter(full, lambda r: ~r["x"].rlike(EXIT_CODE_LINE))
    at = F.coalesce(F.try_element_at(bad, F.lit(-1))["i"], F.try_element_at(plain, F.lit(1))["i"],
                    F.try_element_at(full, F.lit(1))["i"], F.lit(0))
    return F.substring(F.array_join(F.slice(ls, at + 1, F.size(ls)), "\n"), 1, limit)


def _first_line(text: Column | str) -> Column:
    return F.try_element_at(F.filter(lines_of(text), _nonblank), F.lit(1))


def exit_code(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_first_line(text), EXIT_CODE_LINE, 1), F.lit("")).try_cast("int")


def is_user_rejection(text: Column | str) -> Column:
    return F.coalesce(c(text).rlike(USER_REJECTION), F.lit(False))


def error_snippet(text: Column | str) -> Column:
    """First non-blank line, whitespace collapsed, 120 characters."""
    ls = F.transform(F.split(c(text), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    line = F.try_element_at(F.filter(ls, lambda x: x != ""), F.lit(1))
    return F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 119), F.lit("…"))).otherwise(line)


def fnv32(x: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units (exact below U+10000)."""
    codes = F.transform(F.filter(F.split(x, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"),
                       lambda h, v: (h.bitwiseXOR(v) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def hash16(x: Column) -> Column:
    h1 = F.lpad(F.lower(F.hex(fnv32(x))), 8, "0")
    return F.concat(h1, F.lpad(F.lower(F.hex(fnv32(F.concat(x, h1)))), 8, "0"))


def stable_run_id(key: Column) -> Column:
    return F.concat(F.lit("run_"), hash16(key))


def posix(x: Column | str) -> Column:
    return F.translate(c(x), "\\", "/")


def posix_relative_path(path: Column | str, base: str | None = None) -> Column:
    p = posix(path)
    if base is None:
        return p
    b = base.replace("\\", "/").rstrip("/")
    return F.when(p == b, ".").when(p.startswith(b + "/"), F.substring(p, len(b) + 2, 1 << 30)).otherwise(p)


def basename(p: Column) -> Column:
    return F.substring_index(F.regexp_replace(p, "/+$", ""), "/", -1)


def target_spec(source: str, tool: Column | str) -> tuple[Column, Column]:
    """(kind, field) of the tool's target, null for unknown tools."""
    kind = field = None
    for name, (k, f) in TARGETS[source].items():
        cond = c(tool) == name
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
        field = F.when(cond, f) if field is None else field.when(cond, f)
    return kind, field


def tool_target(kind: Column, raw: Column) -> Column:
    """struct(key, kind, display) of a raw file path or command; null when there is none."""
    p = F.when(kind == "command", F.regexp_extract(F.trim(posix(raw)), r"^(\S+)", 1)).otherwise(posix(raw))
    ok = kind.isNotNull() & (F.coalesce(p, F.lit("")) != "")
    return F.when(ok, F.struct(hash16(p).alias("key"), kind.alias("kind"),
                               F.substring(basename(p), 1, 80).alias("display")))


def mcp_server(tool: Column | str) -> Column:
    """Server part of ``mcp__server__tool``."""
    return F.when(c(tool).startswith("mcp__"), F.try_element_at(F.split(c(tool), "__"), F.lit(2)))


def mcp_tool_name(tool: Column | str) -> Column:
    rest = F.array_join(F.slice(F.split(c(tool), "__"), 3, F.greatest(F.size(F.split(c(tool), "__")) - 2, F.lit(0))), "__")
    return F.when(c(tool).startswith("mcp__") & (rest != ""), rest).otherwise(c(tool))


def tool_class() -> Column:
    return (F.when((F.col("kind") == "mcp_call") | F.col("mcp_server").isNotNull(), "mcp")
            .when(F.col("name").isin(SHELL_TOOLS), "shell").when(F.col("name").isin(EDIT_TOOLS), "edit")
            .otherwise("other"))


def script_activity(name: Column | str, fallback: str = "run") -> Column:
    """Activity of the first colon segment that matches a pattern."""
    def one(seg: Column) -> Column:
        e = None
        for pat, act in SCRIPT_PATTERNS:
            e = F.when(seg.rlike(pat), act) if e is None else e.when(seg.rlike(pat), act)
        return e
    acts = F.filter(F.transform(F.split(F.lower(c(name)), ":"), one), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(acts, F.lit(1)), F.lit(fallback))


def path_shapes(text: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(c(text), F.lit(PATH_SHAPES), F.lit(1)), F.array().cast("array<string>"))


def project_key() -> Column:
    return F.coalesce("project_name", F.lit("—"))


def branch_key() -> Column:
    return F.coalesce(F.nullif(F.col("git_branch"), F.lit("")), F.lit("~none"))


def local_day(ms: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(c(ms)), tz))


def instructions_file(source: Column | str) -> Column:
    return (F.when(c(source) == "claude-code", "CLAUDE.md").when(c(source) == "opencode", "AGENTS.md")
            .otherwise("your agent's system prompt"))


def tok_label(n: Column) -> Column:
    """1.2M / 3.4k / 12."""
    return (F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
            .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(n.cast("string")))
