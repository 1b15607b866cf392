"""Which sessions wrote which lines: Git blame joined to recorded commits."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.operators import sequences

# Strengths of evidence, strongest first.
STRENGTHS = ["exact_sha_verified", "exact_sha", "sha_prefix", "message_verified", "message", "subject", "fuzzy"]
MOST_CANDIDATES, MOST_WORDS = 64, 64

LINES = "line long, sha string, summary string, filename string, source_line long"


def read_git(spark: SparkSession, repository: str, path: str) -> DataFrame:
    """LINES of a tracked text file at HEAD. Links, untracked, outside and binary files are rejected, and so is a HEAD that moves meanwhile."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True, text=True).stdout

    whole = os.path.join(repository, path)
    top = os.path.realpath(git("rev-parse", "--show-toplevel").strip())
    if os.path.islink(whole) or not os.path.realpath(whole).startswith(top + os.sep):
        raise ValueError("a link, or a file outside of the repository")
    if not git("ls-files", "--", path).strip():
        raise ValueError("a file that is not tracked")
    with open(whole, "rb") as file:
        if b"\0" in file.read():
            raise ValueError("a binary file")
    head = git("rev-parse", "HEAD")
    rows = parse_porcelain(git("blame", "--line-porcelain", "--", path))
    if git("rev-parse", "HEAD") != head:
        raise RuntimeError("HEAD moved during the reading")
    return spark.createDataFrame(rows, LINES)


def parse_porcelain(output: str) -> list[tuple]:
    """Rows of LINES from git blame --line-porcelain."""
    rows, own = [], {}
    for text in output.split("\n"):
        start = re.match(r"^([0-9a-f]{40}) (\d+) (\d+)", text)
        if text.startswith("\t"):
            rows.append((own["line"], own["sha"], own.get("summary", ""), own.get("filename", ""), own["source"]))
        elif start:
            own = {"sha": start[1], "source": int(start[2]), "line": int(start[3])}
        elif text.startswith("summary "):
            own["summary"] = text[8:]
        elif text.startswith("filename "):
            own["filename"] = text[9:].strip('"')
    return rows


def words(message: Column) -> Column:
    """At most MOST_WORDS different ASCII words of a message, in the order of the text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(message), F.lit("[a-z0-9]+"), F.lit(0))), 1, MOST_WORDS)


def alike(a: Column, b: Column) -> Column:
    """Messages that share two words and half of the shorter, one of four letters; one word alone must be all of it."""
    shared = F.array_intersect(a, b)
    short = F.least(F.size(a), F.size(b))
    long_word = F.exists(shared, lambda w: F.char_length(w) >= 4)
    return long_word & F.when(short == 1, F.size(shared) == 1).otherwise((F.size(shared) >= 2) & (F.size(shared) * 2 >= short))


def scopes(spark: SparkSession, cwds: list[str], repository: str) -> DataFrame:
    """(cwd, state) of recorded folders: verified if their repository is this one, rejected if it is another or the folder is blank, unavailable if there is none any more.

    Asks Git on the driver, each folder once; for the folders that one machine
    recorded.
    """

    def common(folder: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", folder, "rev-parse", "--path-format=absolute", "--git-common-dir"], check=True, capture_output=True, text=True).stdout.strip()
        except (subprocess.CalledProcessError, OSError):
            return None
        return os.path.realpath(out)

    own = common(repository)

    def state(cwd: str) -> str:
        if not cwd.strip():
            return "rejected"
        found = common(cwd.strip())
        return "unavailable" if found is None else "verified" if found == own else "rejected"

    return spark.createDataFrame([(c, state(c)) for c in dict.fromkeys(cwds)], "cwd string, state string")


def observed(prefixes: DataFrame, commits: DataFrame) -> DataFrame:
    """(e_sha, sha, matches): the commit that a recorded beginning (e_sha, four digits at least) names, null if several or none do."""
    own = prefixes.select(F.lower("e_sha").alias("e_sha")).distinct().filter(F.char_length("e_sha") >= 4).withColumn("head", F.substring("e_sha", 1, 4))
    known = commits.select(F.lower("sha").alias("sha")).distinct().withColumn("head", F.substring("sha", 1, 4))
    met = own.join(known, "head").filter(F.col("sha").startswith(F.col("e_sha"))).groupBy("e_sha").agg(F.count("*").alias("matches"), F.min("sha").alias("_s"))
    return own.select("e_sha").join(met, "e_sha", "left").select("e_sha", F.when(F.col("matches") == 1, F.col("_s")).alias("sha"), F.coalesce("matches", F.lit(0)).alias("matches"))


def candidates(commits: DataFrame, evidence: DataFrame, verified: DataFrame | None = None, machine_id: str | None = None, roots: list[str] | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """(sha, session_id, event_id, strength, rank, truncated): evidence for blamed commits, the `most` strongest of each; truncated tells that a commit had more.

    commits: sha, message, one row per commit. evidence: session_id, event_id,
    sha, normalized_message, cwd, and machine_id if one is asked for. verified:
    cwd, state (verified or rejected) of recorded folders; what is rejected
    goes. roots: folders that a recorded folder must be or lie under. Hashes
    meet by their first digits and messages by equality or a shared word, never
    all with all.
    """
    if machine_id is not None:
        evidence = evidence.filter(F.col("machine_id") == machine_id)
    if roots is not None:
        bare = [r.strip().rstrip("/") or "/" for r in roots if r.strip()]
        under = F.lit(False)
        for r in bare:
            under |= (F.col("cwd") == r) | F.col("cwd").startswith("/" if r == "/" else f"{r}/")
        evidence = evidence.filter(under)
    scoped = evidence if verified is None else evidence.join(verified, "cwd", "left").filter("coalesce(state, 'unavailable') <> 'rejected'")
    sure = F.coalesce(F.col("state") == "verified", F.lit(False)) if verified is not None else F.lit(False)
    own = scoped.select("session_id", "event_id", F.lower("sha").alias("e_sha"), "normalized_message", sure.alias("sure"))
    wanted = commits.select("sha", F.lower(F.trim(F.regexp_replace("message", r"\s+", " "))).alias("m")).withColumn("head", F.substring("sha", 1, 4))
    by_sha = wanted.join(own.filter(F.char_length("e_sha") >= 4).withColumn("head", F.substring("e_sha", 1, 4)), "head").filter(F.col("sha").startswith(F.col("e_sha"))).withColumn("rank", F.when((F.col("sha") == F.col("e_sha")) & F.col("sure"), 0).when(F.col("sha") == F.col("e_sha"), 1).otherwise(2))
    by_text = wanted.join(own, F.col("m") == F.col("normalized_message")).withColumn("rank", F.when(F.col("sure"), 3).otherwise(4))
    a = wanted.withColumn("a", words(F.col("m"))).withColumn("w", F.explode("a")).filter(F.char_length("w") >= 4)
    b = own.withColumn("b", words(F.col("normalized_message"))).withColumn("w", F.explode("b"))
    by_words = a.join(b, "w").filter(alike(F.col("a"), F.col("b"))).withColumn("rank", F.lit(6))
    every = by_sha.select("sha", "session_id", "event_id", "rank").union(by_text.select("sha", "session_id", "event_id", "rank")).union(by_words.select("sha", "session_id", "event_id", "rank"))
    best = every.groupBy("sha", "session_id", "event_id").agg(F.min("rank").alias("rank"))
    ordered = sequences.top_per_group(best, ["sha"], [F.col("rank"), F.col("session_id"), F.col("event_id")], most + 1)
    marked = ordered.withColumn("truncated", F.max("place").over(Window.partitionBy("sha")) > most).filter(F.col("place") <= most)
    return marked.select("sha", "session_id", "event_id", F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("rank") + 1).alias("strength"), "rank", "truncated")


def classify(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Adds state: uncommitted, unresolved, ambiguous (several sessions at the best strength) or matched, and the session if one."""
    best = found.withColumn("least", F.min("rank").over(Window.partitionBy("sha"))).filter("rank = least").groupBy("sha").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"), F.min("rank").alias("rank"))
    joined = lines.join(best, "sha", "left")
    state = F.when(F.col("sha").rlike("^0+$"), "uncommitted").when(F.col("sessions").isNull(), "unresolved").when(F.size("sessions") > 1, "ambiguous").otherwise("matched")
    return joined.select(*lines.columns, state.alias("state"), F.when(F.size("sessions") == 1, F.col("sessions")[0]).alias("session_id"), "sessions", "rank")


def coverage(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count("*").alias("lines"), *[F.count_if(F.col("state") == s).alias(s) for s in ("matched", "ambiguous", "unresolved", "uncommitted")])


def by_session(classified: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(session_id, strength, lines, ranges, citations): sessions with the lines they may have written, ambiguous ones for each; strongest first.

    citations, if found is given: the evidence (sha, event_id, strength) for the
    session's lines, strongest first; else empty.
    """
    spread = classified.filter("sessions is not null").select("line", "sha", "rank", F.explode("sessions").alias("session_id"))
    ranges = sequences.islands(spread, ["session_id"], "line").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    counted = spread.groupBy("session_id").agg(F.min("rank").alias("rank"), F.count_distinct("line").alias("lines"))
    out = counted.join(ranges, "session_id")
    none = F.array().cast("array<struct<rank:int,sha:string,event_id:string>>")
    if found is not None:
        cited = found.join(spread.select("sha", "session_id").distinct(), ["sha", "session_id"], "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_set(F.struct(F.col("rank").cast("int").alias("rank"), "sha", "event_id"))).alias("_c"))
        out = out.join(cited, "session_id", "left")
    else:
        out = out.withColumn("_c", none)
    named = lambda rank: F.element_at(F.array(*map(F.lit, STRENGTHS)), rank + 1)
    citations = F.transform(F.coalesce("_c", none), lambda c: F.struct(c["sha"].alias("sha"), c["event_id"].alias("event_id"), named(c["rank"]).alias("strength")))
    return out.orderBy("rank", F.desc("lines"), "session_id").select("session_id", named(F.col("rank")).alias("strength"), "lines", "ranges", citations.alias("citations"))


def unsettled(classified: DataFrame) -> DataFrame:
    """(state, sha, sessions, first, last): runs of lines that are ambiguous, unresolved or uncommitted in the same way."""
    rows = classified.filter("state <> 'matched'").select("line", "state", F.when(F.col("state") != "uncommitted", F.col("sha")).alias("sha"), F.array_join(F.when(F.col("state") == "ambiguous", F.col("sessions")), ",").alias("sessions"))
    keys = ["state", "sha", "sessions"]
    filled = rows.select("line", "state", F.coalesce("sha", F.lit("")).alias("sha"), F.coalesce("sessions", F.lit("")).alias("sessions"))
    return sequences.islands(filled, keys, "line")
