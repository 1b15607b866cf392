import json
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionlake.functions import ids, text
from sessionlake.sources import archive, databases, transcripts
from sessionlake.streaming import incremental


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_lines_keep_offsets_and_physical_numbers(spark, tmp_path):
    write(tmp_path / "a.jsonl", ['{"a": 1}', "", '{"b": "é"}'])
    write(tmp_path / "node_modules/b.jsonl", ["{}"])
    rows = transcripts.lines(spark, [str(tmp_path)]).orderBy("ordinal").collect()
    assert [(r.ordinal, r.byte_offset, r.byte_len) for r in rows] == [(0, 0, 8), (2, 10, 11)]


def test_events_and_sessions_of_mixed_lines(spark, tmp_path):
    write(tmp_path / "s.jsonl", [json.dumps({"type": "session_meta", "payload": {"id": "x1", "cwd": "/w/a"}, "timestamp": "2024-01-01T00:00:00Z"}), json.dumps({"role": "user", "content": "hello", "timestamp": "2024-01-01T00:01:00Z"}), json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": "b"}]}, "timestamp": "no time"})])
    found = transcripts.events(transcripts.lines(spark, [str(tmp_path)]), "codex")
    rows = found.orderBy("ordinal").collect()
    assert [r.event_type for r in rows] == ["session_meta", "user", "assistant"]
    assert rows[1].content == "hello" and json.loads(rows[2].content)["message"]["role"] == "assistant" and rows[2].occurred_at is None
    assert len({r.session_id for r in rows}) == 1 and rows[0].external_id == "x1"
    session = transcripts.sessions(found).collect()[0]
    assert str(session.started_at) == "2024-01-01 00:00:00" and str(session.updated_at) == "2024-01-01 00:01:00" and session.workspace == "/w/a"


def test_a_bad_line_stops_the_file(spark, tmp_path):
    write(tmp_path / "s.jsonl", ["{}", "{bad"])
    found = transcripts.lines(spark, [str(tmp_path)])
    with pytest.raises(PySparkException):
        transcripts.events(found, "codex").collect()
    assert transcripts.events(found, "codex", strict=False).count() == 1


def test_array_file_gives_an_event_per_element(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"role": "user"}, {"role": "assistant"}]')
    (tmp_path / "b.json").write_text('{"role": "user"}')
    assert transcripts.array_events(spark, [str(tmp_path)]).count() == 3


def test_readers_are_registered_once():
    with pytest.raises(ValueError):
        transcripts.register("codex")(None)
    assert transcripts.chosen("agent_logs")[0] == "codex" and transcripts.chosen("omp,omp") == ["omp"]


def test_unpaired_surrogates_are_replaced(spark):
    pair, high, low = "\\ud83d\\ude00", "\\ud800", "\\udc00"
    df = spark.createDataFrame([(f"{pair} {high} x {low}",)], "t string")
    assert df.select(text.whole_surrogates(F.col("t"))).first()[0] == f"{pair} \\ufffd x \\ufffd"


def test_title_index_last_line_wins(spark, tmp_path):
    write(tmp_path / "index.jsonl", ['{"id": "a", "t": "one"}', "broken", '{"id": "a", "t": "two"}'])
    rows = transcripts.title_index(spark, str(tmp_path / "index.jsonl"), "codex", "$.id", "$.t").collect()
    assert [r.title for r in sorted(rows, key=lambda r: r.line)] == ["one", "two"]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"v{k}") for k in range(100)])
        db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
        db.execute("CREATE TABLE part (id TEXT, message_id TEXT, time_created INTEGER, data TEXT)")
        db.execute("INSERT INTO message VALUES ('m1', 's', 1000, '{\"role\": \"user\"}'), ('m2', 's', 2000, '{\"role\": \"system\"}')")
        db.execute("INSERT INTO part VALUES ('p1', 'm1', NULL, '{\"type\": \"text\", \"text\": \"hi\"}'), ('p2', 'm1', 1500, '{\"type\": \"tool\"}'), ('p3', 'm2', 1, '{\"type\": \"text\", \"text\": \"no\"}')")
    df = databases.read_sqlite(spark, path, "SELECT a, b FROM t", "a long, b string", column="a", lower=0, upper=99, partitions=4)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4
    rows = databases.opencode_events(spark, path).collect()
    assert [(r.content, r.ordinal, r.occurred_at.timestamp()) for r in rows] == [("hi", 0, 1.0)]


def test_paged_threads_once_each():
    pages = {1: [{"id": 1}, {"id": 2}], 2: [{"id": 2}, {"id": 3}]}
    assert [t["id"] for t in databases.paged(lambda p: pages.get(p, []))] == [1, 2, 3]
    assert len(databases.paged(lambda p: pages.get(p, []), most_threads=1)) == 1


def test_thread_events_are_cleaned_and_chunked(spark):
    def fetch(thread_id):
        return {"id": "q", "content": "<p>one  two</p>", "created_at": "2024-01-01T00:00:00Z", "answers": [{"id": "a", "role": "system", "content": "abcdef"}, {"id": "a", "content": "again"}]}

    rows = databases.thread_events(spark, ["t"], fetch, chunk=4).orderBy("ordinal").collect()
    assert [(r.content, r.indexable) for r in rows] == [("one ", True), ("two", True), ("abcd", False), ("ef", False)]


def test_archive_round_trip_and_rejections(spark, tmp_path):
    machines = spark.createDataFrame([("m1", "one", "h1"), ("m2", "two", "h2")], "id string, name string, hash string")
    archive.write({"machine": machines}, str(tmp_path / "out"), "test", "2024-01-01T00:00:00Z")
    sound, rejected = archive.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, archive.records(sound, "machine").collect())) == [("m1", "one", "h1"), ("m2", "two", "h2")] and rejected.count() == 0
    good = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    write(tmp_path / "bad.jsonl", ["no json", json.dumps(good | {"schema": "x"}), json.dumps(good | {"id": "other"}), json.dumps(good | {"hash": "other"}), json.dumps(good | {"kind": "x"})])
    sound, rejected = archive.read(spark, str(tmp_path / "bad.jsonl"))
    assert sound.count() == 0 and sorted(r.reason for r in rejected.collect()) == ["hash", "id", "kind", "no envelope", "schema"]


def test_ids_reject_nulls_and_tell_parts_apart(spark):
    row = spark.range(1).select(ids.stable_id(F.lit("a"), F.lit("bc")).alias("x"), ids.stable_id(F.lit("ab"), F.lit("c")).alias("y"), ids.stable_id(F.lit("a"), F.lit(None)).alias("z")).first()
    assert row.x != row.y and row.z is None and row.x.startswith("sc_")


def test_stream_imports_once(spark, tmp_path):
    write(tmp_path / "in/a.txt", ["one", "two", "two"])
    run = lambda: incremental.import_stream(incremental.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), "value").awaitTermination()
    run()
    write(tmp_path / "in/b.txt", ["two", "three"])
    run()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three", "two"]


def test_publication_swaps_whole_versions(spark, tmp_path):
    table = incremental.Published(spark, str(tmp_path / "t"))
    assert table.freshness("w1") == "missing"
    table.publish(spark.range(3), "w1")
    assert table.freshness("w1") == "ready" and table.freshness("w2") == "stale"
    with pytest.raises(PySparkException):
        table.publish(spark.range(3).select(F.raise_error(F.lit("stop"))), "w2")
    assert table.read().count() == 3
    assert table.log().orderBy("updated_at").collect()[-1].state == "failed"
    table.publish(spark.range(5), "w2")
    assert table.read().count() == 5


def test_of_two_publishers_one_wins(spark, tmp_path):
    table = incremental.Published(spark, str(tmp_path / "t"))
    base = table.number()
    table.publish(spark.range(1), "w1", expected=base)
    with pytest.raises(incremental.Conflict):
        table.publish(spark.range(2), "w2", expected=base)
    assert table.read().count() == 1 and table.number() == 1
    failed = incremental.Published(spark, str(tmp_path / "f"))
    with pytest.raises(PySparkException):
        failed.publish(spark.range(3).select(F.raise_error(F.lit("stop"))), "w")
    assert failed.freshness("w") == "failed"


def test_projections_follow_touched_keys(spark, tmp_path):
    source = spark.createDataFrame([(f"s{k % 4}", k) for k in range(20)], "session_id string, x long")
    derive = lambda rows: rows.groupBy("session_id").agg(F.sum("x").alias("x"))
    dirty, held = incremental.Dirty(spark, str(tmp_path / "d")), incremental.Published(spark, str(tmp_path / "p"))
    dirty.touch(source)
    assert incremental.maintain(held, dirty, source, derive) == ("rebuild", 1) and incremental.maintain(held, dirty, source, derive) == ("unchanged", 1)
    assert incremental.compatible(held.last(), 1, "1") == "ready" and incremental.compatible(held.last(), 2, "1") == "stale" and incremental.compatible(held.last(), 1, "2") == "missing"
    more = source.union(spark.createDataFrame([("s1", 100), ("s9", 1)], source.schema))
    dirty.touch(spark.createDataFrame([("s1",), ("s9",)], "session_id string"))
    assert incremental.maintain(held, dirty, more, derive) == ("incremental", 2)
    assert sorted(map(tuple, held.read().collect())) == sorted(map(tuple, derive(more).collect()))
    dirty.touch(spark.createDataFrame([("s2",)], "session_id string"))

    def meanwhile(rows):
        dirty.touch(spark.createDataFrame([("s3",)], "session_id string"))
        return derive(rows)

    with pytest.raises(incremental.Conflict):
        incremental.maintain(held, dirty, more, meanwhile)
    assert incremental.maintain(held, dirty, more, derive, version="2")[0] == "rebuild"


def test_scoped_refresh_equals_full(spark):
    source = spark.createDataFrame([(k % 5, k) for k in range(50)], "session_id long, x long")
    derive = lambda rows: rows.groupBy("session_id").agg(F.sum("x").alias("x"))
    stale = derive(source).withColumn("x", F.when(F.col("session_id") < 2, -1).otherwise(F.col("x")))
    fresh = incremental.scoped(derive, source, stale, spark.createDataFrame([(0,), (1,)], "session_id long"))
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, derive(source).collect()))


def test_event_time_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0) ts, 'a' event_type, 1L user_id FROM range(50)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = incremental.activity_windows(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["events"] for r in spark.table("windows").collect()} == {24, 2}


def test_opencode_sessions(spark, tmp_path):
    path = str(tmp_path / "o.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT, project_id TEXT, parent_id TEXT, slug TEXT, directory TEXT, title TEXT, version TEXT, time_created INTEGER, time_updated INTEGER, time_archived INTEGER)")
        db.execute("INSERT INTO session VALUES ('a', 'p', NULL, 's', '/w/./x/', ' ', '1', 1000, 2000, NULL), ('b', 'p', 'a', 's', 'rel', 'T', '1', 3000, 4000, 5000)")
    rows = {r.external_id: r for r in databases.opencode_sessions(spark, path).collect()}
    assert (rows["a"].title, rows["a"].status, rows["a"].workspace, rows["a"].started_at.timestamp()) == (None, "open", "/w/x", 1.0)
    assert (rows["b"].title, rows["b"].status, rows["b"].workspace, json.loads(rows["b"].metadata)["opencode_parent_id"]) == ("T", "archived", None, "a")
    assert "opencode" in transcripts.READERS


def test_scopes_of_answers(spark):
    answer = {"id": "q", "content": "<b>said</b>", "url": {"title": "Title", "address": "http://a", "text": "page"}}
    assert [databases.content_parts(answer, s) for s in databases.SCOPES] == [[("text", "<b>said</b>")], [("text", "<b>said</b>"), ("url_metadata", "Title\nhttp://a")], [("text", "<b>said</b>"), ("url_metadata", "Title\nhttp://a"), ("url_full_text", "page")]]
    rows = databases.thread_events(spark, ["t"], lambda t: answer | {"created_at": "2024-01-01T00:00:00Z"}, scope="full_text")
    assert [(r.ordinal, r.origin, r.content) for r in rows.orderBy("ordinal").collect()] == [(0, "text", "said"), (1, "url_metadata", "Title http://a"), (2, "url_full_text", "page")]
    assert databases.thread_sessions(rows).first().event_count == 3


def test_database_and_its_log_share_a_cursor(spark, tmp_path):
    (tmp_path / "o.db").write_text("x")
    listing = lambda: transcripts.files(spark, [str(tmp_path)], "o.db*")
    alone = transcripts.paired_cursor(listing(), "o.db").first().cursor
    (tmp_path / "o.db-wal").write_text("yy")
    both = transcripts.paired_cursor(listing(), "o.db").collect()
    assert alone.endswith("|none") and len(both) == 1 and both[0].cursor != alone


def test_a_changed_file_gives_its_new_events(spark, tmp_path):
    write(tmp_path / "s.jsonl", ['{"role": "user", "content": "a"}'])
    first, every = transcripts.update_path(spark, str(tmp_path / "s.jsonl"), "codex", spark.createDataFrame([], "event_id string"))
    assert first.count() == 1
    held = spark.createDataFrame(every.collect(), "event_id string")
    write(tmp_path / "s.jsonl", ['{"role": "user", "content": "a"}', '{"role": "assistant", "content": "b"}'])
    fresh, touched = transcripts.update_path(spark, str(tmp_path / "s.jsonl"), "codex", held)
    assert [r.content for r in fresh.collect()] == ["b"] and touched.count() == 2


def test_a_stream_is_spilt_to_whole_files(spark, tmp_path):
    lines = [json.dumps({"n": k}).encode() for k in range(1000)]
    assert archive.spill(spark, iter(lines), str(tmp_path / "in"), file_bytes=2_000) == 1000
    names = sorted(p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith("."))
    assert len(names) > 3 and all(n.startswith("part-") for n in names)
    assert spark.read.text(str(tmp_path / "in")).count() == 1000 and archive.spill(spark, iter([]), str(tmp_path / "none")) == 0


def test_adapters_tell_what_is_current(spark, tmp_path):
    write(tmp_path / ".codex/sessions/a.jsonl", ['{"role": "user", "content": "a"}'])
    write(tmp_path / ".codex/sessions/b.jsonl", ['{"role": "user", "content": "b"}'])
    own = transcripts.adapters(str(tmp_path), "codex,omp")
    assert own["omp"].discover(spark).count() == 0
    found = own["codex"].discover(spark)
    told = own["codex"].is_current(found, found.filter("path like '%a.jsonl'").select("path", "cursor"))
    assert {r.path.rsplit("/", 1)[1]: r.current for r in told.collect()} == {"a.jsonl": True, "b.jsonl": False}
    assert sorted(r.content for r in own["codex"].prepare(spark, transcripts.local_roots(str(tmp_path), "codex")).collect()) == ["a", "b"]
