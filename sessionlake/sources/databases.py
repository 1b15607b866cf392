"""SQLite databases and paged HTTP answers as Spark data sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sessionlake.sources import transcripts


class SqliteSource(DataSource):
    """spark.read.format("sqlite"): options path, query and schema; with column, lower, upper and partitions it is read in ranges of that whole-number column.

    A database file is local to one machine, so it must lie where executors see it.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), len(schema.fields))


class _Range(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width

    def partitions(self) -> list[InputPartition]:
        if "column" not in self.options:
            return [_Range(None, None)]
        low, high, n = (int(self.options[k]) for k in ("lower", "upper", "partitions"))
        cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [_Range(a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import sqlite3

        query = self.options["query"]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            if partition.first is not None:
                query = f"SELECT * FROM ({query}) WHERE {self.options['column']} BETWEEN {partition.first} AND {partition.last}"
            yield from db.execute(query)


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, **ranges: int | str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("query", query).option("schema", schema)
    for key, value in ranges.items():
        reader = reader.option(key, value)
    return reader.load()


def opencode_events(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, ordinal, message_id, role, content, occurred_at): text parts of users and assistants, in order of message and part; the part's time, else the message's."""
    rows = read_sqlite(
        spark,
        path,
        "SELECT m.session_id, m.id, p.id, m.time_created, p.time_created, m.data, p.data FROM message m JOIN part p ON p.message_id = m.id",
        "external_id string, message_id string, part_id string, message_ms long, part_ms long, message string, part string",
    )
    said = rows.filter((F.get_json_object("part", "$.type") == "text") & F.get_json_object("message", "$.role").isin("user", "assistant"))
    from pyspark.sql import Window

    order = Window.partitionBy("external_id").orderBy("message_ms", "message_id", "part_ms", "part_id")
    return said.select("external_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "message_id", F.get_json_object("message", "$.role").alias("role"), F.get_json_object("part", "$.text").alias("content"), F.timestamp_millis(F.coalesce("part_ms", "message_ms")).alias("occurred_at"))


OPENCODE_SESSIONS = "external_id string, project_id string, parent_id string, slug string, directory string, title string, version string, created_ms long, updated_ms long, archived_ms long"


def opencode_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, external_id, title, status, started_at, updated_at, workspace, metadata) of the database's sessions; an archived one says so, a blank title is none."""
    from sessionlake.functions import ids
    from sessionlake.functions import text as texts

    rows = read_sqlite(spark, path, "SELECT id, project_id, parent_id, slug, directory, title, version, time_created, time_updated, time_archived FROM session", OPENCODE_SESSIONS)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    workspace = F.when(F.col("directory").rlike(r"^\s*/"), texts.clean_path(F.trim("directory")))
    meta = F.to_json(F.struct(F.lit(path).alias("path"), workspace.alias("workspace_path"), F.col("project_id").alias("opencode_project_id"), blank(F.col("parent_id")).alias("opencode_parent_id"), F.col("slug").alias("opencode_slug"), F.col("version").alias("opencode_version")))
    return rows.select(ids.stable_id(F.lit("session"), F.lit("opencode"), F.lit(path), F.col("external_id")).alias("session_id"), "external_id", blank(F.col("title")).alias("title"), F.when(F.col("archived_ms").isNotNull(), "archived").otherwise("open").alias("status"), F.timestamp_millis("created_ms").alias("started_at"), F.timestamp_millis("updated_ms").alias("updated_at"), workspace.alias("workspace"), meta.alias("metadata"))


@transcripts.register("opencode")
def opencode_reader(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Events of opencode databases, each with its path."""
    out = None
    for path in paths:
        own = opencode_events(spark, path).withColumn("path", F.lit(path))
        out = own if out is None else out.unionByName(own)
    return out


def paged(fetch: Callable[[int], list[dict]], most_pages: int = 1000, most_threads: int | None = None) -> list[dict]:
    """Threads of a paged answer until an empty page or a limit, each id once. fetch gives the threads of a page."""
    seen: dict[str, dict] = {}
    for page in range(1, most_pages + 1):
        threads = fetch(page)
        if not threads:
            break
        for thread in threads:
            seen.setdefault(str(thread["id"]), thread)
            if most_threads and len(seen) >= most_threads:
                return list(seen.values())
    return list(seen.values())


#: What of an answer is taken: its text; also the title and address of what it links to; also that page's text.
SCOPES = {"text_only": 1, "url_metadata": 2, "full_text": 3}


def content_parts(answer: dict, scope: str = "text_only") -> list[tuple[str, str]]:
    """(origin, text) of an answer's parts within a scope; parts that are not there are left out."""
    depth = SCOPES[scope]
    link = answer.get("url") if isinstance(answer.get("url"), dict) else {}
    said = answer.get("display_content") if answer.get("display_content") is not None else answer.get("content")
    parts = [("text", said), ("url_metadata", "\n".join(x for x in (link.get("title"), link.get("address")) if x)), ("url_full_text", link.get("text"))]
    return [(origin, content) for origin, content in parts[:depth] if isinstance(content, str) and content.strip()]


THREAD_EVENTS = "thread_id string, ordinal long, answer_id string, origin string, part int, role string, content string, indexable boolean, occurred_at timestamp"


def thread_events(spark: SparkSession, thread_ids: list[str], fetch: Callable[[str], dict], partitions: int = 8, chunk: int = 24_000, scope: str = "text_only") -> DataFrame:
    """THREAD_EVENTS, one thread fetched in each task after another: the parent first, answers once by id, the parts that the scope takes, texts in chunks; what the system says is not indexed."""
    from sessionlake.functions import text

    def load(batches):
        import pandas as pd

        for frame in batches:
            for thread_id in frame["thread_id"]:
                thread = fetch(thread_id)
                rows, seen = [], set()
                for answer in [thread, *thread.get("answers", ())]:
                    if answer["id"] not in seen:
                        seen.add(answer["id"])
                        rows += [(thread_id, str(answer["id"]), len(seen), n, origin, answer.get("role", "user"), content, answer.get("created_at")) for n, (origin, content) in enumerate(content_parts(answer, scope))]
                yield pd.DataFrame(rows, columns=["thread_id", "answer_id", "place", "piece", "origin", "role", "content", "created_at"])

    names = spark.createDataFrame([(i,) for i in thread_ids], "thread_id string").repartition(min(partitions, max(1, len(thread_ids))))
    raw = names.mapInPandas(load, "thread_id string, answer_id string, place int, piece int, origin string, role string, content string, created_at string")
    cleaned = raw.withColumn("content", text.html_text(F.col("content")))
    spread = cleaned.select("thread_id", "answer_id", "place", "piece", "origin", "role", "created_at", F.posexplode(text.chunks(F.col("content"), chunk)).alias("part", "content"))
    from pyspark.sql import Window

    order = Window.partitionBy("thread_id").orderBy("place", "piece", "part")
    return spread.select("thread_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "answer_id", "origin", "part", "role", "content", (F.col("role") != "system").alias("indexable"), F.try_to_timestamp("created_at").alias("occurred_at"))


def thread_sessions(found: DataFrame) -> DataFrame:
    """(thread_id, started_at, updated_at, event_count) of thread_events(): the first and last time of a thread."""
    return found.groupBy("thread_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("updated_at"), F.count("*").alias("event_count"))
