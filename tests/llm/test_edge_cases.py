"""Every operator and stage over empty tables, null columns, odd texts, repeated rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import bpe, chat, neighbours, packing, queries_urls, registry, secrets, similar, simhash, tiff, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 250_000 + "x" * 300_000 + " token=abcdefgh12345 " + "é\U0001f600 " * 2_000
TEXTS = [None, "", " \t\n", "a", "\x00\x01", "''s's ' 's", "é" * 50, "same text here again now", "same text here again now", "SAME TEXT here again NOW", LONG]
CLASHING = ["_id", "_spans", "_gone", "node", "bucket", "fp", "name", "sketch", "blob", "packed", "cls", "rank", "shard", "score", "spans"]


def odd_docs(spark):
    rows = [(k, t, None if k % 2 else "en", None, None) for k, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "a text without an id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def per_document(path_ranks):
    return {
        "secrets": lambda d: secrets.scan(d, ["doc_id"]).paths,
        "bpe": lambda d: bpe.encode(d, path_ranks),
        "digests": lambda d: bpe.digests(d, path_ranks),
        "tiff": tiff.round_trip,
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels(d.sparkSession))),
    }


@pytest.mark.parametrize("name", ["secrets", "bpe", "digests", "tiff", "simhash", "toxicity"])
def test_each_row_has_a_result(spark, ranks_path, name):
    operator = per_document(ranks_path)[name]
    docs = odd_docs(spark)
    assert sorted(str(r[0]) for r in operator(docs).select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    assert operator(docs.limit(0)).count() == 0


def test_packing_covers_odd_documents(spark, tokenizer_path):
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, tokenizer_path).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packing.pack_documents(docs.limit(0), tokenizer_path).count() == 0


def test_groups_of_odd_documents(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r.kept_id for r in similar.groups(docs).collect()}
    assert got[8] == got[7] == got[9] == 7 and got[1] == got[0] == 0 and got[2] == 2 and got[5] == 5
    assert similar.groups(docs.limit(0)).count() == 0
    kept = similar.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [0, 2, 3, 4, 5, 6, 7, 10, None]))
    assert similar.keep_one(docs).columns == docs.columns and similar.keep_one(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_keeps_each_different_one(spark):
    copy = "one two three four five six seven eight nine ten"
    rows = [(1, "a text of its own that nobody else has written down"), (1, copy), (2, copy), (0, copy), (1, copy), (None, copy), (None, "without an id but with words of its own"), (None, "without an id but with words of its own"), (5, "five words are here now"), (5, "five words are here now")]
    docs = spark.createDataFrame([(*r, "x" if k % 2 else None) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.text) for r in similar.keep_one(docs).collect())
    assert got == sorted([("1", rows[0][1]), ("0", copy), ("None", rows[6][1]), ("5", rows[8][1])])


def test_chats_of_odd_turns(spark):
    rows = [(None, None, None, None), (1, 2, "assistant", None), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, None, "odd\nrole\\", "x"), (2, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_turn", F.lit("x")).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text")))).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got[1].n_turns == 4 and [t.role for t in got[1].turns] == ["odd\nrole\\", "user", "user", "assistant"] and got[2].turns[0].text == LONG and got[None].n_turns == 1
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_urls_of_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>words"), (4, "HTTP://ÄB.Example.COM/en/x?y#z", "<script>x"), (4, "HTTP://ÄB.Example.COM/en/x?y#z", "<script>x"), (None, "x://net/es/", LONG), (6, "a://", None), (7, "a://com", None), (8, "a://xcom/", None), (9, "a://" + "b" * 5000 + "/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("word", F.lit("y"))
    split = urls.split_pages(pages, queries_urls.RULES)
    got = urls.judge(split, urls.train(split)).collect()
    assert len(got) == 10
    by = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None) and by[4] == ("Äb.example.com", "/en/x", "example.com/en/") and by[None] == ("net", "/es/", "net/es/") and by[7] == ("com", "", None) and by[8][2] is None
    empty = urls.split_pages(pages.limit(0), queries_urls.RULES)
    assert urls.judge(empty, urls.train(empty)).count() == 0


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [0.0, 1.0]), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0]), (50, [1.0, 0.1]), (100, None), (150, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("side", F.lit("y"))
    got = [tuple(r) for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, *_ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_odd_records_of_archives(spark):
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, bucket string, base string"
    rows = [(1, "http://A.com/x#f", 10, "response", 200, '"1"', None, None, {"ETag": '"1"', "Server": "s"}), (2, "https://www.a.com:443/x/?utm_source=q", 10, "revisit", 304, '"1"', None, None, None), (3, "http://a.com/x", 11, "revisit", 304, '"1"', None, None, {"Date": "d", "Server": "no"}), (3, "http://a.com/x", 11, "revisit", 304, '"1"', None, None, {"Date": "d", "Server": "no"}), (4, "http://a.com/x", 200_000, "revisit", 304, '"2"', None, None, None), (5, "http://a.com/x", 300_000, "revisit", 304, None, None, "d", None), (6, None, 5, "revisit", None, None, None, None, None), (7, "http://a.com/x", None, "revisit", None, None, None, None, None), (8, "http://a.com/x", 1, "response", 404, None, None, None, None), (9, "u", 1, None, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    got = [(r.record_id, r.outcome, r.response_id, r.headers) for r in warc.resolve(df).orderBy("record_id").collect()]
    assert [g[:3] for g in got] == [(2, "orphan", None), (3, "resolved", 1), (3, "resolved", 1), (4, "mismatch", 1), (5, "unvalidated", 1), (6, "orphan", None), (7, "orphan", None)]
    assert got[1][3] == {"etag": '"1"', "server": "s", "date": "d"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_header_names_that_differ_in_case(spark):
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(1, "http://a.com/x", 10, "response", 200, '"1"', None, None, {"ETag": '"0"', "etag": '"1"', "SERVER": "s", "server": None}), (2, "http://a.com/x", 11, "revisit", 304, '"1"', None, None, {"Date": "d", "DATE": "e"})]
    got = warc.resolve(spark.createDataFrame(rows, schema)).collect()
    assert [(r.record_id, r.headers) for r in got] == [(2, {"etag": '"1"', "server": None, "date": "d"})]


@pytest.mark.parametrize("rows", [50_000, 3])
def test_revisits_of_a_crowded_url(spark, rows):
    import random

    rng = random.Random(3)
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"
    records = [(k, "http://a.com/x" if k % 3 else "http://b.com/", rng.randrange(0, 9_000), rng.choice(["response", "revisit"]), 200, None, None, None, None) for k in range(400)]
    want = {}
    for k, url, ts, kind, *_ in records:
        if kind == "revisit":
            earlier = [(t, r) for r, u, t, what, *_ in records if what == "response" and u == url and t < ts]
            want[k] = max(earlier)[1] if earlier else None
    got = warc.resolve(spark.createDataFrame(records, schema), bucket_seconds=1_000, bucket_rows=rows)
    assert {r.record_id: r.response_id for r in got.collect()} == want


def test_stages_over_odd_documents(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert {r.doc_id for r in out.collect()} >= {0, 3, 4, 5, 6, 7, 10, None}, name
        assert stage(spark, out, str(tmp_path)).count() <= out.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() > 0
    assert "token=abcdefgh12345" not in {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()}[10]


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in registry.QUERIES if name.startswith("op")} == {f"op{n}" for n in range(1, 11)}
