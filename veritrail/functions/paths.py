"""Paths and ids as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix; anything else is text.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rb": "ruby",
    ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".php": "php", ".swift": "swift", ".lua": "lua", ".zig": "zig",
    ".ps1": "powershell", ".ex": "elixir", ".exs": "elixir", ".m": "objc", ".mm": "objc", ".jl": "julia",
    ".md": "markdown", ".sh": "shell", ".bash": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".sql": "sql", ".html": "html", ".css": "css",
}
# Languages with an extractor of symbols, by suffix; .mjs and .cjs have none, .toc has Lua's.
EXTRACTED = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".rb", ".cs", ".kt", ".kts", ".scala",
    ".php", ".swift", ".lua", ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl",
)
# Levels of depth by rank, and the folders that are never indexed.
LEVELS = ("path", "file", "symbol", "graph")
SKIPPED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "DerivedData", "Pods", ".build")


def suffix(path: Column) -> Column:
    """The last suffix in lower case; none for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(table[suffix(path)], F.lit("text"))


def has_extractor(path: Column) -> Column:
    return suffix(path).isin(*EXTRACTED)


def namespace(path: Column) -> Column:
    """The first 12 hex digits of the path's sha256."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 12)


def node_id(path: Column, raw: Column | str = "__file__") -> Column:
    return F.concat(namespace(path), F.lit(":"), F.lit(raw) if isinstance(raw, str) else raw)


def line_of(place: Column) -> Column:
    """The number of `L<number>`, else null."""
    return F.when(place.rlike(r"^L[0-9]+$"), F.substring(place, 2, 20).try_cast("bigint"))


def rank_of(level: Column) -> Column:
    """0 to 3, -1 for anything else."""
    return (F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1).cast("bigint")


def expand_home(path: Column, home: str) -> Column:
    return F.when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1_000_000))).otherwise(path)


def skipped(path: Column, home: str | None = None) -> Column:
    """Paths that are never indexed: relative, temporary, hidden or Library in the home folder, or below a skipped folder."""
    out = ~path.startswith("/") | path.startswith("/tmp/") | path.startswith("/private/tmp/")
    if home:
        out = out | path.startswith(f"{home}/.") | path.startswith(f"{home}/Library/")
    return out | path.rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/")


def root_regex(pattern: str) -> str:
    """A root pattern as a regular expression: a literal prefix on a folder boundary, or a glob where * stays within a segment and ** doesn't."""
    if "*" not in pattern:
        return "^" + re.escape(pattern.rstrip("/")) + "(/|$)"
    parts = re.split(r"(\*\*|\*)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def depth_for(path: Column, roots: dict[str, str], default: str = "max", cap: str = "graph") -> Column:
    """struct(requested, effective, clamped): the longest matching root decides, of equally long ones the first.

    `max` asks for what the capability allows; asking for more is clamped to it. Roots of an unknown level are ignored; an
    unknown default counts as `max`.
    """
    known = [(p, v) for p, v in roots.items() if v in LEVELS or v == "max"]
    wanted = F.lit(default if default in LEVELS or default == "max" else "max")
    for pattern, level in sorted(known[::-1], key=lambda x: len(x[0])):  # the last test made wins
        wanted = F.when(path.rlike(root_regex(pattern)), F.lit(level)).otherwise(wanted)
    asked = F.when(wanted == "max", F.lit(cap)).otherwise(wanted)
    over = rank_of(asked) > LEVELS.index(cap)
    return F.struct(wanted.alias("requested"), F.when(over, F.lit(cap)).otherwise(asked).alias("effective"), over.alias("clamped"))


def drift_label(before: Column, after: Column) -> Column:
    return F.concat(F.lit("depth "), before, F.lit(" -> "), after)


def rewrite_path(text: Column, old: Column, new: Column) -> Column:
    """old replaced by new where it ends at a slash, a blank or the end."""
    quoted = F.concat(F.lit(r"\Q"), old, F.lit(r"\E(?=/| |$)"))
    return F.regexp_replace(text, quoted, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def watch_roots(roots: dict[str, str], home: str = "~") -> list[str]:
    """The folders to watch for these root patterns: each one's literal beginning, home expanded, once each, in order."""
    full = (home + p[1:] if p.startswith("~/") else p for p in roots)
    return list(dict.fromkeys(x for x in (p.split("*")[0].rstrip("/") for p in full) if x))


def prose_anchors(text: Column, tops: tuple[str, ...] = ("home", "srv", "opt", "data"), reach: int = 8) -> Column:
    """array<struct<base, words>>: each path that prose names, in order of appearance, with the next `reach` words.

    A path starts with ~/ or one of the top folders inside a word (words end at blanks and double quotes) and runs to the word's
    end, without closing punctuation, brackets and the number of a line. `a.{b,c}` names a.b and a.c. Null text has none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r'[ \t\r\n\f"]+'), lambda w: w != "")
    raw = lambda w: F.regexp_extract(w, r"(?s)(?:~|/(?:" + "|".join(tops) + r"))/.*\z", 0)
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"['.,;:)\]`]+\z", ""), r":[0-9]+\z", "")
    pre, inner, post = (lambda p, i=i: F.regexp_extract(p, r"(?s)^([^{]*)\{([^}]*)\}?(.*)\z", i) for i in (1, 2, 3))
    forms = lambda p: F.when(p.contains("{"), F.transform(F.split(inner(p), ","), lambda x: F.concat(pre(p), x, post(p)))).otherwise(F.array(p))
    each = F.transform(words, lambda w, i: F.struct(clean(raw(w)).alias("p"), F.slice(words, i + 2, reach).alias("words")))
    named = F.filter(each, lambda x: x["p"] != "")
    return F.flatten(F.transform(named, lambda x: F.transform(forms(x["p"]), lambda p: F.struct(p.alias("base"), x["words"].alias("words")))))


def home_relative(path: Column, home: str = r"/home/[^/]+") -> Column:
    """The path below a home folder; a path elsewhere stays as it is."""
    return F.regexp_replace(path, rf"^{home}/", "")


def selftest_path(id_: Column) -> Column:
    """The path inside a selftest id, `selftest:<path>:<what>`; null for other ids."""
    return F.nullif(F.regexp_extract(id_, r"^selftest:(.*?)(?::[^:]*)?$", 1), F.lit(""))


# Fixed value: what a quoted path in a hint looks like.
QUOTED = r'"((?:/|~/)[^"\\]{1,4096})"'
# Fixed value: quoted strings with a slash, or bare words that start with ~ or / and hold these characters only.
COMMAND = r"""\"([^\"]*/[^\"]*)\"|'([^']*/[^']*)'|([~/][a-zA-Z0-9_\-./]+)"""


def quoted_paths(raw: Column, home: str) -> Column:
    """Every quoted absolute or home path of 1 to 4096 characters in arbitrary text, expanded, in order, once each."""
    found = F.regexp_extract_all(raw, F.lit(QUOTED), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: expand_home(p, home)))


def command_paths(command: Column, home: str) -> Column:
    """Absolute paths in a shell command, in order, once each; more than there are rather than fewer."""
    one = lambda i: F.regexp_extract_all(command, F.lit(COMMAND), F.lit(i))
    merged = F.transform(F.arrays_zip(one(1).alias("a"), one(2).alias("b"), one(3).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))
    return F.array_distinct(F.filter(F.transform(merged, lambda p: expand_home(p, home)), lambda p: p.startswith("/")))
