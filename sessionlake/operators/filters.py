"""Predicates that reports, search and maintenance share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where sessions keep their workspace.
WORKSPACE_PATHS = ["$.workspace_path", "$.workspace_root", "$.cwd", "$.workspace.path", "$.workspace.root", "$.workspace.cwd"]
# Corpora by their names.
CORPORA = {"conversation": "conversation", "conversations": "conversation", "messages": "conversation", "tool": "tool", "tools": "tool", "raw": "raw", "events": "raw"}


def project_like(path: Column, part: str) -> Column:
    """Case-insensitive containment in which % and _ are wildcards."""
    return path.ilike(f"%{part}%")


def metadata_paths(metadata: Column) -> Column:
    """The paths that a session's metadata names, sorted, each once."""
    every = F.array(*[F.get_json_object(metadata, p) for p in WORKSPACE_PATHS])
    return F.array_sort(F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != ""))))


def in_scope(paths: Column, scope: str) -> Column:
    """Any path is the scope or lies under it."""
    root = scope.rstrip("/")
    return F.exists(paths, lambda p: (F.rtrim(p, F.lit("/")) == root) | p.startswith(f"{root}/"))


def has_basename(path: Column, name: str) -> Column:
    return (path == name) | path.endswith(f"/{name}")


def machine(df: DataFrame, machines: DataFrame, wanted: str) -> DataFrame:
    """Rows of a machine by exact id or by name in any case; machines is a small table."""
    ids = machines.filter((F.col("id") == wanted) | (F.lower("name") == wanted.lower())).select(F.col("id").alias("machine_id"))
    return df.join(ids, "machine_id", "left_semi")


def corpora(names: str) -> list[str]:
    """Tiers of a comma-separated list, each once."""
    found = []
    for name in filter(None, (n.strip().lower() for n in names.split(","))):
        if name not in CORPORA:
            raise ValueError(f"unknown corpus {name}")
        if CORPORA[name] not in found:
            found.append(CORPORA[name])
    if not found:
        raise ValueError("no corpus")
    return found


def embeddable(text: Column, policy: Column) -> Column:
    return (F.char_length(F.trim(text)) >= 80) & (policy != "never")


# What texts of instructions begin with or hold.
INSTRUCTIONS_BEGIN = ["# agents.md instructions", "<instructions>", "<permissions instructions>"]


def instructions(role: Column, text: Column) -> Column:
    """Text that instructs the agent and that nobody said."""
    start = F.lower(F.ltrim(text))
    wanted = F.lower(role).isin("system", "developer") | F.contains(start, F.lit("<instructions>"))
    for prefix in INSTRUCTIONS_BEGIN:
        wanted |= start.startswith(prefix)
    return wanted


def contains_any_case(part: str, *columns: Column) -> Column:
    wanted = F.lit(False)
    for c in columns:
        wanted |= F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))
    return wanted


def has_terms(text: Column, terms: list[str], every: bool = True) -> Column:
    """ASCII-case-insensitive substrings; no terms keep all."""
    if not terms:
        return F.lit(True)
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = F.array(*[F.lit(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in terms])
    test = F.forall if every else F.exists
    return test(wanted, lambda t: F.contains(lower, t))


def sha_prefixes(sha: Column, least: int = 4) -> Column:
    """All beginnings of a hex name of at least so many digits."""
    return F.when(F.char_length(sha) >= least, F.transform(F.sequence(F.lit(least), F.greatest(F.char_length(sha), F.lit(least))), lambda n: F.substring(F.lower(sha), F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def prunable(sessions: DataFrame, session_ids: list[str] | None = None, source_kinds: list[str] | None = None, machine_ids: list[str] | None = None, scope: str | None = None, basename: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Sessions that all given conditions choose; none given chooses none."""
    given = [c for c in (session_ids, source_kinds, machine_ids, scope, basename, after, before) if c is not None]
    wanted = F.lit(bool(given))
    if session_ids is not None:
        wanted &= F.col("session_id").isin(session_ids)
    if source_kinds is not None:
        wanted &= F.col("source_kind").isin(source_kinds)
    if machine_ids is not None:
        wanted &= F.col("machine_id").isin(machine_ids)
    if scope is not None:
        wanted &= in_scope(F.array("workspace"), scope)
    if basename is not None:
        wanted &= has_basename(F.col("workspace"), basename)
    if after is not None:
        wanted &= F.col("latest") >= F.lit(after).cast("timestamp")
    if before is not None:
        wanted &= F.col("latest") < F.lit(before).cast("timestamp")
    return sessions.filter(wanted)


def glob(column: Column, pattern: str) -> Column:
    """A whole match, case told apart: * is any run, ? any character, [..] one of a set, [^..] none of it."""
    out, k = "", 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        end = pattern.find("]", k + 1 + (pattern[k : k + 1] == "^")) if c == "[" else -1
        if end > 0:
            body = pattern[k:end]
            out += "[" + ("^" if body.startswith("^") else "") + re.sub(r"([\\\[\]&~])", r"\\\1", body.lstrip("^")) + "]"
            k = end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c)
    return column.rlike(f"(?s)^{out}$")
