"""Incremental maintenance: change detection, scoped recomputation, atomic publication, and streams of new files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def reconcile(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged by a hash; unchanged rows need no writing."""
    both = old.select(key, F.col(mark).alias("_o")).join(new.select(key, F.col(mark).alias("_n")), key, "full")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed").alias("change"))


def scoped(derive: Callable[[DataFrame], DataFrame], source: DataFrame, held: DataFrame, scope: DataFrame, key: str = "session_id") -> DataFrame:
    """A derived table after a change in scope: the scope is derived anew from its source rows, the rest is kept."""
    wanted = scope.select(key).distinct()
    return held.join(wanted, key, "left_anti").unionByName(derive(source.join(wanted, key, "left_semi")))


def changed_files(listing: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files whose size or time differs from what was read before."""
    return listing.join(checkpoints.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


class Conflict(RuntimeError):
    """Somebody else published meanwhile, or the input changed."""


class Published:
    """A table of versions in a folder: a version is written whole, then becomes the current one; a failed one changes nothing.

    Each version has a number. Its pointer is a file that is created only if
    there is none of that number, which a file system like HDFS does for one
    writer alone: of two that began at the same version one gets a Conflict and
    its data is never read. A log beside it tells what is being built and what
    failed.
    """

    STATUS = "number int, version string, watermark string, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _log(self, state: str, watermark: str, why: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(state).alias("state"), F.lit(watermark).alias("watermark"), F.lit(why).cast("string").alias("last_error"), F.current_timestamp().alias("updated_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def number(self) -> int:
        """The current version's number, 0 if there is none."""
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0)

    def publish(self, table: DataFrame, watermark: str, *partition_by: str, expected: int | None = None) -> str:
        """Write a version and make it the current one. expected: the number() that the table was derived from; another one now is a Conflict."""
        base = self.number() if expected is None else expected
        version = uuid.uuid4().hex
        self._log("building", watermark)
        try:
            writer = table.write.partitionBy(*partition_by) if partition_by else table.write
            writer.parquet(f"{self.path}/data/{version}")
            self._point(base + 1, version, watermark)
        except Exception as why:
            self._log("failed", watermark, f"{type(why).__name__}: {str(why)[:500]}")
            raise
        return version

    def _point(self, number: int, version: str, watermark: str) -> None:
        if self.number() != number - 1:
            raise Conflict(f"{self.path} is at version {self.number()}, not {number - 1}")
        fs, target = self._fs(f"{self.path}/versions/{number:09d}")
        line = json.dumps({"number": number, "version": version, "watermark": watermark, "updated_at": datetime.now(timezone.utc).isoformat()}) + "\n"
        fs.mkdirs(target.getParent())
        try:
            made = fs.createNewFile(target)
        except Exception as why:
            raise Conflict(f"version {number} of {self.path} is there already") from why
        if not made:
            raise Conflict(f"version {number} of {self.path} is there already")
        pointer = fs.create(target, True)
        pointer.write(bytearray(line.encode()))
        pointer.close()

    def status(self) -> DataFrame:
        """All versions: number, version, watermark, updated_at. A pointer that is still empty is not told."""
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self.STATUS)
        lines = self.spark.read.text(f"{self.path}/versions").filter("value <> ''")
        return lines.select(F.from_json("value", self.STATUS).alias("s")).select("s.*")

    def log(self) -> DataFrame:
        """(state, watermark, last_error, updated_at): what was begun and what failed."""
        fs, folder = self._fs(f"{self.path}/log")
        schema = "state string, watermark string, last_error string, updated_at timestamp"
        return self.spark.read.schema(schema).parquet(f"{self.path}/log") if fs.exists(folder) else self.spark.createDataFrame([], schema)

    def last(self):
        return self.status().orderBy(F.desc("number")).first()

    def freshness(self, watermark: str) -> str:
        """ready or stale against a source's watermark, by the current version; without one missing, or building or failed by the last entry of the log."""
        last = self.last()
        if last is not None:
            return "ready" if last["watermark"] == watermark else "stale"
        begun = self.log().orderBy(F.desc("updated_at")).first()
        return begun["state"] if begun else "missing"

    def read(self) -> DataFrame:
        last = self.last()
        if last is None:
            raise LookupError(f"nothing is published in {self.path}")
        return self.spark.read.parquet(f"{self.path}/data/{last['version']}")


class Dirty:
    """The keys that changed since a projection was last published, by revisions that only go up.

    Each import notes the keys it touched under a new revision; a projection
    reads those beyond its own, derives them anew, and is published with the
    revision it read as its watermark. Notes that all projections have seen may
    go. Revisions are made as Published makes numbers.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "session_id"):
        self.notes, self.key, self.spark = Published(spark, path), key, spark

    def revision(self) -> int:
        return self.notes.number()

    def touch(self, keys: DataFrame) -> int:
        """Notes keys under the next revision, and tells it."""
        at = self.revision()
        self.notes.publish(keys.select(self.key).distinct(), str(at + 1), expected=at)
        return at + 1

    def since(self, revision: int, to: int | None = None) -> DataFrame:
        """(key): touched after a revision, up to another one or the last."""
        rows = self.notes.status().filter(F.col("number") > revision)
        found = [r["version"] for r in (rows if to is None else rows.filter(F.col("number") <= to)).collect()]  # a row for each import since then
        if not found:
            return self.spark.createDataFrame([], f"{self.key} string")
        return self.spark.read.parquet(*[f"{self.notes.path}/data/{v}" for v in found]).distinct()


def maintain(published: Published, dirty: Dirty, source: DataFrame, derive: Callable[[DataFrame], DataFrame], *partition_by: str, version: str = "1", widen: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, int]:
    """(mode, revision): brings a projection to the sources' last revision, whole or in part.

    Without a version, or with one of another version of the deriving code, it
    is a rebuild; if nothing was touched it is unchanged; else incremental: the
    touched keys, widened by a function of them, are derived anew and the rest
    is kept. The input may change while it is read: then the revision has moved,
    and instead of publishing a Conflict is raised.
    """
    at, base, last = dirty.revision(), published.number(), published.last()
    held = last["watermark"].split(":") if last is not None else None
    if held is None or held[1] != version:
        table, mode = derive(source), "rebuild"
    elif int(held[0]) == at:
        return "unchanged", at
    else:
        touched = dirty.since(int(held[0]), at)
        scope = widen(touched) if widen else touched
        table, mode = scoped(derive, source, published.read(), scope, dirty.key), "incremental"
    if dirty.revision() != at:
        raise Conflict("the input changed before the table was written")
    published.publish(table, f"{at}:{version}", *partition_by, expected=base)
    return mode, at


def compatible(last, revision: int, version: str) -> str:
    """missing, ready or stale: the state of a projection whose last() watermark is revision:version of its code; another version counts as missing."""
    if last is None or last["watermark"].split(":")[1:] != [version]:
        return "missing"
    return "ready" if int(last["watermark"].split(":")[0]) == revision else "stale"


def delta(stored: DataFrame, records: DataFrame, key: str = "id", mark: str = "hash") -> DataFrame:
    """(key, change) of an import: inserted, or touched if the key is stored with another hash; unchanged records are left out."""
    both = records.select(key, F.col(mark).alias("_n")).dropDuplicates([key]).join(stored.select(key, F.col(mark).alias("_o")), key, "left")
    return both.select(key, F.when(F.col("_o").isNull(), "inserted").when(F.col("_o") != F.col("_n"), "touched").alias("change")).filter("change is not null")


def stream_lines(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """New lines of text files under a folder as a stream: value, path, modified."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


#: Folders by a hash of the key that a stream's target is dealt to.
KEY_BUCKETS = 256


def import_stream(stream: DataFrame, target: str, checkpoint: str, key: str, once: bool = True, every: str | None = None, buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Append a stream's rows whose key the target does not have; a batch that is run again adds nothing. every: a processing interval, such as 1 hour.

    The target is a table by bucket, a hash of the key, so a batch reads the
    keys of its own buckets alone and a small batch a small part of the target.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            fresh = own
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                wanted = [r["_bucket"] for r in own.select("_bucket").distinct().collect()]  # `buckets` numbers at most
                held = spark.read.schema(own.schema).parquet(target).filter(F.col("_bucket").isin(wanted)).select("_bucket", key)
                fresh = own.join(held, ["_bucket", key], "left_anti")
            fresh.select(*own.columns).repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(target)
        finally:
            own.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if every:
        writer = writer.trigger(processingTime=every)
    elif once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# Extensions: the reference semantics have no event-time streams; these give its calendar and rhythms for them.


def activity_windows(stream: DataFrame, width: str = "1 day", late: str = "2 hours", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts of events by tumbling windows of event time, rows that come later than `late` left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("events")).select("window.start", "window.end", by, "events")


def session_windows(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a user: events with no gap longer than `gap` between them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("events")).select("session_window.start", "session_window.end", by, "events")
