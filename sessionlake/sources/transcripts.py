"""Agents' logs as events: discovery, lines with their offsets, and fields found by fallback paths.

One file mixes shapes, so no schema is inferred: a line stays text and each
field is the first of several paths that it has.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import ids, text
from sessionlake.operators import derive

# Kinds of local logs with their folders under a home.
ROOTS = {
    "codex": [".codex/sessions", ".codex/archived_sessions"],
    "claude_code": [".claude/projects"],
    "pi_agent": [".pi/agent/sessions"],
    "omp": [".omp/agent/sessions"],
    "openclaw": [".openclaw"],
    "hermes": [".hermes/sessions"],
    "opencode": [".local/share/opencode/opencode.db"],
}
SKIPPED_FOLDERS = {".git", "node_modules", "target"}
# Where events keep their fields, the first that is there counts.
ROLE = ["$.role", "$.message.role", "$.payload.role"]
TYPE = ["$.type", "$.payload.type"]
TIME = ["$.timestamp", "$.created_at", "$.message.created_at"]
SESSION = ["$.sessionId", "$.session_id", "$.payload.id"]
WORKSPACE = ["$.cwd", "$.current_working_directory", "$.workspace", "$.workspace_path", "$.project_path", "$.repo_path", "$.payload.cwd", "$.payload.current_working_directory", "$.payload.workspace", "$.payload.workspace_path", "$.payload.project_path", "$.payload.repo_path", "$.payload.git.root", "$.turn_context.payload.cwd", "$.git.root"]
BRANCH = ["$.gitBranch", "$.git_branch", "$.branch", "$.payload.gitBranch", "$.payload.git_branch", "$.payload.branch", "$.payload.git.branch", "$.git.branch"]
REPOSITORY = ["$.git_repo", "$.git_remote", "$.repository_url", "$.repo_url", "$.payload.git_repo", "$.payload.git_remote", "$.payload.repository_url", "$.payload.repo_url", "$.payload.git.remote", "$.payload.git.repository_url", "$.git.remote", "$.git.repository_url"]

READERS: dict[str, object] = {}


def register(kind: str):
    """Add a reader of (spark, roots) -> lines under a kind of source; a kind has one reader."""

    def add(reader):
        if kind in READERS:
            raise ValueError(f"{kind} has a reader")
        READERS[kind] = reader
        return reader

    return add


def chosen(names: str) -> list[str]:
    """Kinds of a comma-separated list; agent_logs stands for all local ones."""
    found: list[str] = []
    for name in filter(None, (n.strip() for n in names.split(","))):
        for kind in ROOTS if name == "agent_logs" else [name]:
            if kind not in found:
                found.append(kind)
    return found


@dataclass
class Adapter:
    """What an import asks of a kind of source: where its files are, which of them are as they were read, and their events."""

    kind: str
    home: str
    pattern: str = "*.jsonl"
    concurrency: int = 1  # files that are read at once where a service limits it; local files have no limit

    def discover(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """(path, length, modificationTime, cursor) of the files under the kind's folders; no folders, no rows."""
        roots = local_roots(self.home, self.kind)
        if not roots:
            return spark.createDataFrame([], "path string, length long, modificationTime timestamp, cursor string")
        return fingerprint(files(spark, roots, self.pattern, most))

    def is_current(self, found: DataFrame, checkpoints: DataFrame) -> DataFrame:
        """found with current: whether a file was read as it is now. checkpoints: path, cursor."""
        read = checkpoints.select("path", F.col("cursor").alias("_c"))
        return found.join(read, "path", "left").withColumn("current", F.coalesce(F.col("_c") == F.col("cursor"), F.lit(False))).drop("_c")

    def prepare(self, spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
        """Events of files, through the kind's registered reader."""
        found = READERS[self.kind](spark, paths)
        return events(found, self.kind, strict) if "line" in found.columns else found


def adapters(home: str, names: str = "agent_logs") -> dict[str, Adapter]:
    """Adapters of the chosen kinds under a home."""
    return {kind: Adapter(kind, home, "*.db" if kind == "opencode" else "*.jsonl") for kind in chosen(names) if kind in ROOTS}


def local_roots(home: str, kind: str) -> list[str]:
    folders = ROOTS[kind]
    return [p for p in (os.path.join(home, f) for f in folders) if os.path.exists(p)]


def files(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", most: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of files under roots, newest first; folders of tools and builds are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots).select("path", "length", "modificationTime")
    for folder in sorted(SKIPPED_FOLDERS):
        found = found.filter(~F.contains("path", F.lit(f"/{folder}/")))
    newest = found.orderBy(F.desc("modificationTime"), "path")
    return newest.limit(most) if most else newest


def fingerprint(listing: DataFrame) -> DataFrame:
    """Adds cursor: what tells a changed file."""
    return listing.withColumn("cursor", F.concat_ws(":", F.lit("size-mtime"), "length", F.unix_micros("modificationTime")))


LINES = "path string, ordinal long, byte_offset long, byte_len long, line string"


def lines(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """LINES of files: physical line numbers and byte ranges; blank lines are left out and still counted."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows, at = [], 0
                for n, raw in enumerate(bytes(content).split(b"\n")):
                    if raw.strip():
                        rows.append((path, n, at, len(raw), raw.decode("utf-8", "replace").rstrip("\r")))
                    at += len(raw) + 1
                    if len(rows) >= 5_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])
                        rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    for folder in sorted(SKIPPED_FOLDERS):
        found = found.filter(~F.contains("path", F.lit(f"/{folder}/")))
    return found.select("path", "content").mapInPandas(cut, LINES)


def array_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LINES of JSON files: an array has an event per element, an object is one."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return whole.select("path", F.posexplode(items).alias("n", "line")).select("path", F.col("n").cast("long").alias("ordinal"), F.lit(0).cast("long").alias("byte_offset"), F.octet_length("line").cast("long").alias("byte_len"), "line")


def _first(line: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(line, p) for p in paths])


def looks_like_path(value: Column) -> Column:
    """A value that begins as an absolute path or one under a home, else null."""
    return F.when(value.rlike(r"^\s*(/|~/)"), value)


def events(found: DataFrame, source_kind: str, strict: bool = True) -> DataFrame:
    """Events of lines: ids by content, role, type, time (RFC 3339 only), content (derive.stored_content), workspace.

    strict: a line that is no JSON stops the job; else it is left out. The
    session is the one that any line of the file names first, else the file.
    """
    line = text.whole_surrogates(F.col("line")) if source_kind == "omp" else F.col("line")
    parsed = F.try_parse_json(line)
    good = F.when(parsed.isNotNull(), line)
    checked = F.coalesce(good, F.raise_error(F.concat(F.lit("no JSON in "), F.col("path"), F.lit(" at line "), F.col("ordinal").cast("string")))) if strict else good
    rows = found.withColumn("line", checked).filter("line is not null")
    role = _first(F.col("line"), ROLE)
    fields = rows.select(
        "path",
        "ordinal",
        "byte_offset",
        "byte_len",
        "line",
        role.alias("role"),
        F.coalesce(_first(F.col("line"), TYPE), role, F.lit("event")).alias("event_type"),
        F.coalesce(*[F.try_to_timestamp(F.when(F.get_json_object("line", p).rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d"), F.get_json_object("line", p))) for p in TIME]).alias("occurred_at"),
        _first(F.col("line"), SESSION).alias("named"),
        derive.contents("line").alias("content"),
        F.coalesce(*[looks_like_path(F.get_json_object("line", p)) for p in WORKSPACE]).alias("workspace"),
        _first(F.col("line"), BRANCH).alias("git_branch"),
        _first(F.col("line"), REPOSITORY).alias("git_repository"),
        ids.content_hash(F.encode("line", "UTF-8")).alias("hash"),
    )
    names = fields.groupBy("path").agg(F.min_by("named", F.when(F.col("named").isNotNull(), F.col("ordinal"))).alias("external_id"))
    with_session = fields.join(names, "path").withColumn("external_id", F.coalesce("external_id", F.regexp_extract("path", r"([^/]+?)(\.[^.]*)?$", 1)))
    session = ids.stable_id(F.lit("session"), F.lit(source_kind), F.col("path"), F.col("external_id"))
    return with_session.withColumn("source_kind", F.lit(source_kind)).withColumn("session_id", session).withColumn("event_id", ids.stable_id(F.lit("event"), F.lit(source_kind), F.col("session_id"), F.col("ordinal"), F.col("hash"))).drop("named")


def sessions(found: DataFrame) -> DataFrame:
    """Sessions of events: started by the first time in line order, updated by the last, workspace by the first that looks like one."""
    timed = F.when(F.col("occurred_at").isNotNull(), F.col("ordinal"))
    return found.groupBy("session_id", "source_kind", "external_id", "path").agg(F.min_by("occurred_at", timed).alias("started_at"), F.max_by("occurred_at", timed).alias("updated_at"), F.min_by("workspace", F.when(F.col("workspace").isNotNull(), F.col("ordinal"))).alias("workspace"), F.max("ordinal").alias("max_ordinal"), F.count("*").alias("event_count"))


def project_folder(path: Column) -> Column:
    """The workspace that the name of a log's folder spells, slashes written as -: a guess, as names may hold - themselves; else null."""
    name = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(name.rlike("^-."), F.concat(F.lit("/"), F.replace(F.substring(name, 2, 100_000), F.lit("-"), F.lit("/"))))


def workspaces(found: DataFrame, home: str | None = None, git_roots: DataFrame | None = None) -> DataFrame:
    """(session_id, workspace_path, workspace_root, cwd, git_repo, git_branch, confidence) of sessions that tell where they worked.

    The first event that names a path decides, with its branch and repository;
    ~/ is the given home. The root is the deepest of git_roots (root: folders
    that hold a .git, as the caller's file system knows) at or above the path,
    else the path. A claude_code log whose events name none takes the name of
    its folder, which is inferred.
    """
    expand = lambda c: F.when(c.startswith("~/") & F.lit(home is not None), F.concat(F.lit((home or "").rstrip("/")), F.substring(c, 2, 100_000))).otherwise(c)
    named = F.when(F.col("workspace").isNotNull(), F.col("ordinal"))
    first = found.groupBy("session_id", "source_kind", "path").agg(F.min_by(F.struct("workspace", "git_branch", "git_repository"), named).alias("w"))
    said = text.clean_path(expand(F.trim("w.workspace")))
    guess = F.when(F.col("source_kind") == "claude_code", text.clean_path(project_folder(F.col("path"))))
    told = first.select("session_id", F.coalesce(said, guess).alias("workspace_path"), said.alias("cwd"), F.when(said.isNotNull(), F.col("w.git_repository")).alias("git_repo"), F.when(said.isNotNull(), F.col("w.git_branch")).alias("git_branch"), F.when(said.isNotNull(), "observed").otherwise("inferred").alias("confidence")).filter("workspace_path is not null")
    if git_roots is None:
        return told.withColumn("workspace_root", F.col("workspace_path"))
    depth = F.size(F.split("cwd", "/"))
    above = told.filter("cwd is not null").select("session_id", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("cwd", "/"), F.lit(1), n), "/"))).alias("root")).withColumn("root", F.when(F.col("root") == "", "/").otherwise(F.col("root")))
    deepest = above.join(git_roots.select("root").distinct(), "root").groupBy("session_id").agg(F.max_by("root", F.char_length("root")).alias("_root"))
    return told.join(deepest, "session_id", "left").withColumn("workspace_root", F.coalesce("_root", "workspace_path")).drop("_root")


def paired_cursor(listing: DataFrame, database: str) -> DataFrame:
    """(path, cursor) of a database that is written through a log beside it: either file's size or time changes the cursor; a missing log is told as none."""
    own = fingerprint(listing.filter(F.col("path").endswith(database) | F.col("path").endswith(f"{database}-wal")))
    part = lambda wal: F.max(F.when(F.col("path").endswith("-wal") == F.lit(wal), F.col("cursor")))
    both = own.groupBy(F.regexp_replace("path", "-wal$", "").alias("path")).agg(part(False).alias("_db"), part(True).alias("_wal"))
    return both.filter("_db is not null").select("path", F.concat_ws("|", "_db", F.coalesce("_wal", F.lit("none"))).alias("cursor"))


def update_path(spark: SparkSession, path: str, source_kind: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to append, event_id of all events of the file) of one changed file: lines that are there already are found by their ids."""
    found = events(lines(spark, [path], "*"), source_kind)
    return found.join(held.select("event_id"), "event_id", "left_anti"), found.select("event_id")


for _kind in ROOTS:
    if _kind != "opencode":  # its reader is in sources.databases
        register(_kind)(lines)


def title_index(spark: SparkSession, path: str, source_kind: str, id_path: str, title_path: str) -> DataFrame:
    """(source_kind, external_id, title, line) of a JSONL index; lines that are no JSON are left out."""
    rows = lines(spark, [path], "*")
    return rows.select(F.lit(source_kind).alias("source_kind"), F.get_json_object("line", id_path).alias("external_id"), F.get_json_object("line", title_path).alias("title"), F.col("ordinal").alias("line")).filter("external_id is not null and title is not null")
