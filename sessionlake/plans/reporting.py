"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.functions import dates, text
from sessionlake.operators import report
from sessionlake.plans import model
from sessionlake.plans.catalog import query

AS_OF = "2024-01-20 00:00:00"


def _toks(spark: SparkSession, sf_dir: str, human: bool = True) -> DataFrame:
    rows = model.provenance(spark, sf_dir)
    rows = rows.filter("authored_by = 'human'") if human else rows
    return rows.select("item_id", "session_id", "workspace", "kind", "authored_by", "occurred_at", text.words(F.col("text")).alias("toks"))


def _day_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


@query("report_totals", """
SELECT count(*) AS sessions, count(*) FILTER (session_class <> 'subagent') AS threads, coalesce(sum(event_count), 0)::BIGINT AS events, min(first_event_at) AS first_activity, max(last_event_at) AS last_activity,
  coalesce(sum(human), 0)::BIGINT AS human_messages, coalesce(sum(agent), 0)::BIGINT AS agent_messages, coalesce(sum(assistant), 0)::BIGINT AS assistant_messages, coalesce(sum(harness), 0)::BIGINT AS harness_messages
FROM facts LEFT JOIN (SELECT session_id, count(*) FILTER (authored_by = 'human') AS human, count(*) FILTER (authored_by = 'agent') AS agent, count(*) FILTER (authored_by = 'assistant') AS assistant, count(*) FILTER (authored_by = 'harness') AS harness FROM provenance GROUP BY 1) p USING (session_id)
WHERE last_event_at >= TIMESTAMP '2024-01-02' AND first_event_at < TIMESTAMP '2024-06-01'
""")
def report_totals(spark, sf_dir):
    return report.totals(model.facts(spark, sf_dir), model.provenance(spark, sf_dir), "2024-01-02", "2024-06-01")


_CALENDAR = """
SELECT d.day::VARCHAR AS day, coalesce(s.n, 0) AS sessions, coalesce(h.n, 0) AS human_messages
FROM (SELECT (DATE '2024-01-20' - i::INT) AS day FROM range(365) r(i)) d
LEFT JOIN (SELECT first_event_at::DATE AS day, count(*) AS n FROM facts GROUP BY 1) s USING (day)
LEFT JOIN (SELECT occurred_at::DATE AS day, count(*) AS n FROM provenance WHERE authored_by = 'human' GROUP BY 1) h USING (day)
"""


@query("activity_calendar", _CALENDAR)
def activity_calendar(spark, sf_dir):
    return _day_as_text(report.calendar(model.facts(spark, sf_dir), model.provenance(spark, sf_dir), AS_OF))


@query("calendar_levels", f"""
WITH d AS ({_CALENDAR}), s AS (SELECT day, ceil(4 * cume_dist() OVER (ORDER BY sessions))::INT AS level FROM d WHERE sessions > 0)
SELECT d.*, coalesce(level, 0) AS level FROM d LEFT JOIN s USING (day)
""")
def calendar_levels(spark, sf_dir):
    return _day_as_text(report.calendar_levels(report.calendar(model.facts(spark, sf_dir), model.provenance(spark, sf_dir), AS_OF)))


_PERIODS = """
SELECT w.days, m.*, CASE WHEN age >= 0 AND age < w.days * 86400 THEN 'current' WHEN age >= w.days * 86400 AND age < 2 * w.days * 86400 THEN 'previous' END AS period
FROM (VALUES (7), (14), (28)) w(days), m"""


@query("period_comparison", f"""
WITH e AS (
  SELECT first_event_at AS ts, 'sessions' AS metric, 1 AS n FROM facts
  UNION ALL SELECT occurred_at, 'human_messages', 1 FROM provenance WHERE authored_by = 'human'
  UNION ALL SELECT last_event_at, 'tokens', greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(cached_input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0) FROM facts),
m AS (SELECT *, date_diff('second', ts, TIMESTAMP '{AS_OF}') AS age FROM e),
p AS ({_PERIODS}),
s AS (SELECT days, metric, sum(CASE WHEN period = 'current' THEN n ELSE 0 END)::BIGINT AS current, sum(CASE WHEN period = 'previous' THEN n ELSE 0 END)::BIGINT AS previous FROM p WHERE period IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN previous <> 0 THEN round((current - previous) * 100.0 / previous)::BIGINT END AS percent FROM s
""")
def period_comparison(spark, sf_dir):
    return report.comparison(model.facts(spark, sf_dir), model.provenance(spark, sf_dir), AS_OF)


@query("project_changes_top2", f"""
WITH m AS (SELECT workspace, date_diff('second', occurred_at, TIMESTAMP '{AS_OF}') AS age FROM provenance WHERE authored_by = 'human'),
p AS ({_PERIODS}),
s AS (SELECT days, regexp_extract(workspace, '([^/]+)/*$', 1) AS project, count(*) FILTER (period = 'current') AS current, count(*) FILTER (period = 'previous') AS previous FROM p WHERE period IS NOT NULL GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN previous <> 0 THEN round((current - previous) * 100.0 / previous)::BIGINT END AS percent FROM s),
t AS (SELECT *, CASE WHEN previous = 0 THEN (current + previous) * 100 ELSE abs(percent) END AS score FROM q WHERE current + previous >= 20 AND abs(current - previous) >= 5 AND (previous = 0 OR abs(percent) >= 20))
SELECT *, row_number() OVER (PARTITION BY days ORDER BY score DESC, project) AS place FROM t QUALIFY place <= 2
""")
def project_changes_top2(spark, sf_dir):
    return report.project_changes(model.provenance(spark, sf_dir), AS_OF)


@query("tokens_by_day", """
SELECT last_event_at::DATE::VARCHAR AS day, greatest(coalesce(sum(input_tokens), 0), 0)::BIGINT AS input_tokens, greatest(coalesce(sum(cached_input_tokens), 0), 0)::BIGINT AS cached_input_tokens, greatest(coalesce(sum(output_tokens), 0), 0)::BIGINT AS output_tokens
FROM facts WHERE last_event_at IS NOT NULL GROUP BY 1
""")
def tokens_by_day(spark, sf_dir):
    return _day_as_text(report.tokens_by_day(model.facts(spark, sf_dir)))


@query("tokens_by_model", """
SELECT coalesce(primary_model, 'unknown') AS model, sum(coalesce(input_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS tokens FROM facts GROUP BY 1 HAVING tokens > 0
""")
def tokens_by_model(spark, sf_dir):
    return report.tokens_by_model(model.facts(spark, sf_dir))


@query("projects_rollup", """
SELECT workspace, count(*) AS sessions, coalesce(sum(human), 0)::BIGINT AS human_messages,
  sum(CASE WHEN coalesce(input_tokens, cached_input_tokens, output_tokens) IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(output_tokens, 0) END)::BIGINT AS total_tokens,
  sum(duration_secs)::BIGINT AS duration_secs, max(last_event_at) AS last_activity, regexp_extract(workspace, '([^/]+)/*$', 1) AS project
FROM facts LEFT JOIN (SELECT session_id, count(*) AS human FROM provenance WHERE authored_by = 'human' GROUP BY 1) h USING (session_id) GROUP BY workspace
""")
def projects_rollup(spark, sf_dir):
    return report.projects(model.facts(spark, sf_dir), model.provenance(spark, sf_dir))


@query("mix_by_month", """
SELECT 'provider' AS axis, strftime(first_event_at, '%Y-%m') AS month, source_kind AS name, count(*) AS sessions FROM facts WHERE trim(source_kind) <> '' GROUP BY 2, 3
UNION ALL SELECT 'model', strftime(first_event_at, '%Y-%m'), primary_model, count(*) FROM facts WHERE trim(primary_model) <> '' GROUP BY 2, 3
""")
def mix_by_month(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    return report.mix_by_month(facts, "source_kind").select(F.lit("provider").alias("axis"), "*").union(report.mix_by_month(facts, "primary_model").select(F.lit("model"), "*"))


@query("rhythms_hour_weekday", """
SELECT 'hour' AS axis, strftime(occurred_at, '%H') AS label, count(*) AS human_messages FROM provenance WHERE authored_by = 'human' GROUP BY 2
UNION ALL SELECT 'weekday', strftime(occurred_at, '%w'), count(*) FROM provenance WHERE authored_by = 'human' GROUP BY 2
""")
def rhythms_hour_weekday(spark, sf_dir):
    return report.rhythms(model.provenance(spark, sf_dir))


_DAYPARTS = """
SELECT p.label, coalesce(sum(n), 0)::BIGINT AS human_messages, round(coalesce(sum(n), 0) * 100.0 / greatest(sum(sum(n)) OVER (), 1), 6) AS share_percent, round(p.hours * 100.0 / 24, 6) AS baseline_percent
FROM (VALUES ('morning', 0, 11, 12), ('afternoon', 12, 16, 5), ('evening', 17, 23, 7)) p(label, first, last, hours)
LEFT JOIN (SELECT hour(occurred_at) AS h, count(*) AS n FROM provenance WHERE authored_by = 'human' GROUP BY 1) c ON h BETWEEN first AND last GROUP BY p.label, p.hours
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("dayparts", _DAYPARTS)
def dayparts(spark, sf_dir):
    return _rounded(report.dayparts(model.provenance(spark, sf_dir)), "share_percent", "baseline_percent")


# all messages between noon and ten in the evening, so that there is something to tell
_LATE = "date_trunc('day', occurred_at) + to_hours(12 + hour(occurred_at) % 10)"


@query("daypart_insights", f"""
WITH d AS ({_DAYPARTS.replace("hour(occurred_at) AS h", f"hour({_LATE}) AS h")}) SELECT *, round(share_percent / baseline_percent, 4) AS lift FROM d
WHERE human_messages >= 50 AND share_percent / baseline_percent >= 1.25 AND share_percent - baseline_percent >= 5 ORDER BY lift DESC, label LIMIT 2
""")
def daypart_insights(spark, sf_dir):
    late = model.provenance(spark, sf_dir).withColumn("occurred_at", F.timestamp_add("HOUR", 12 + F.hour("occurred_at") % 10, F.date_trunc("day", F.col("occurred_at"))))
    return report.daypart_insights(_rounded(report.dayparts(late), "share_percent", "baseline_percent")).withColumn("lift", F.round("lift", 4))


def _attributed(spark, sf_dir):
    from sessionlake.operators import sequences

    carried = sequences.carry_model(model.provenance(spark, sf_dir), "session_id", ["ordinal", "item_id"], "model")
    return carried.filter("authored_by = 'human' and carried_model is not null").select("item_id", "session_id", "occurred_at", F.col("carried_model").alias("model"), text.words(F.col("text")).alias("toks"))


_ATTRIBUTED = """
c AS (SELECT item_id, session_id, occurred_at, last_value(i.model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal, item_id ROWS UNBOUNDED PRECEDING) AS model, authored_by FROM items i JOIN (SELECT item_id, authored_by FROM provenance) p USING (item_id)),
a AS (SELECT c.*, toks FROM c JOIN (SELECT item_id, toks FROM toks) t USING (item_id) WHERE c.authored_by = 'human' AND model IS NOT NULL)"""

# words of the test corpus, which has none of the usual ones
_TERMS = ["the", "was", "from"]


_FRUSTRATION = f"""
WITH {_ATTRIBUTED},
b AS (SELECT session_id, strftime(occurred_at, '%Y-%m') AS month, model, count(*) AS n, count(*) FILTER (list_has_any(toks, {_TERMS})) AS matches FROM a GROUP BY 1, 2, 3),
d AS (SELECT b.*, f.duration_secs * n / sum(n) OVER (PARTITION BY session_id) AS secs FROM b LEFT JOIN facts f USING (session_id))
SELECT month, model, sum(matches)::BIGINT AS matches, sum(n)::BIGINT AS messages, round(sum(secs))::BIGINT AS duration_secs FROM d GROUP BY 1, 2
"""


@query("frustration_by_month_model", _FRUSTRATION)
def frustration_by_month_model(spark, sf_dir):
    return report.frustration(_attributed(spark, sf_dir), model.facts(spark, sf_dir), _TERMS)


@query("frustration_merge_months", f"""
WITH {_ATTRIBUTED},
x AS (SELECT strftime(occurred_at, '%Y-%m') AS month, model, count(*) AS matches FROM a WHERE list_contains(toks, 'from') GROUP BY 1, 2),
y AS (SELECT strftime(occurred_at, '%Y-%m') AS month, model, count(*) AS messages FROM a GROUP BY 1, 2)
SELECT coalesce(x.month, y.month) AS month, coalesce(x.model, y.model) AS model, coalesce(matches, 0) AS matches, coalesce(messages, 0) AS messages FROM x FULL JOIN y ON x.month = y.month AND x.model = y.model
""")
def frustration_merge_months(spark, sf_dir):
    rows = _attributed(spark, sf_dir).withColumn("month", dates.month(F.col("occurred_at")))
    return report.merged_months(rows.filter(F.array_contains("toks", "from")).groupBy("month", "model").agg(F.count("*").alias("matches")), rows.groupBy("month", "model").agg(F.count("*").alias("messages")))


@query("frustration_summary", f"""
WITH p AS ({_FRUSTRATION}), m AS (SELECT model, sum(matches)::BIGINT AS matches, sum(messages)::BIGINT AS messages, sum(duration_secs)::BIGINT AS duration_secs FROM p GROUP BY 1),
r AS (SELECT *, CASE WHEN duration_secs > 0 THEN matches * 3600.0::DOUBLE / duration_secs END AS per_hour, (sum(matches) OVER ()) * 3600.0::DOUBLE / nullif(sum(duration_secs) OVER (), 0) AS whole FROM m)
SELECT model, matches, messages, duration_secs, round(per_hour, 6) AS per_hour, round(CASE WHEN abs(per_hour - whole) < 0.005 THEN 0 ELSE per_hour - whole END, 6) AS delta FROM r
""")
def frustration_summary(spark, sf_dir):
    return _rounded(report.frustration_summary(report.frustration(_attributed(spark, sf_dir), model.facts(spark, sf_dir), _TERMS), full=True), "per_hour", "delta")


@query("duration_allocation", f"""
WITH {_ATTRIBUTED},
b AS (SELECT session_id, model, count(*) AS n FROM a GROUP BY 1, 2)
SELECT session_id, model, n, round(f.duration_secs * n / sum(n) OVER (PARTITION BY session_id))::BIGINT AS secs FROM b LEFT JOIN facts f USING (session_id)
""")
def duration_allocation(spark, sf_dir):
    from sessionlake.operators import sequences

    by = _attributed(spark, sf_dir).groupBy("session_id", "model").agg(F.count("*").alias("n"))
    return sequences.allocate(by.join(model.facts(spark, sf_dir).select("session_id", "duration_secs"), "session_id", "left"), "session_id", "n", "duration_secs").select("session_id", "model", "n", F.round("allocated").cast("long").alias("secs"))


def _stop(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Three words seldom come together thrice in the test corpus.
_LEAST = {1: 3, 2: 3, 3: 1}


def _ngram_sql(n: int) -> str:
    keep = f"strlen(g[1]) > 1 AND NOT list_contains({_stop(text.STOPWORDS)}, g[1])" if n == 1 else f"len(list_filter(g, lambda w : NOT list_contains({_stop(text.STOPWORDS)}, w))) > 0"
    return f"""
WITH e AS (SELECT item_id, unnest(list_transform(range(1, len(toks) - {n} + 2), lambda k : toks[k:k + {n - 1}])) AS g FROM toks WHERE authored_by = 'human'),
c AS (SELECT item_id, array_to_string(g, ' ') AS term, least(count(*), 3) AS n FROM e WHERE {keep} GROUP BY 1, 2)
SELECT term, sum(n)::BIGINT AS count FROM c GROUP BY 1 HAVING sum(n) >= {_LEAST[n]} ORDER BY count DESC, term LIMIT 20"""


for _n, _name in ((1, "ngram_unigrams"), (2, "ngram_bigrams"), (3, "ngram_trigrams")):
    query(_name, _ngram_sql(_n))(lambda spark, sf_dir, n=_n: report.ngrams(_toks(spark, sf_dir), n, _LEAST[n]))


@query("project_terms_tfidf", f"""
WITH e AS (SELECT workspace, item_id, unnest(list_filter(toks, lambda w : strlen(w) > 2 AND NOT list_contains({_stop(text.STOPWORDS + text.PROJECT_NOISE)}, w))) AS term FROM toks WHERE authored_by = 'human'),
p AS (SELECT workspace, item_id, term, least(count(*), 3) AS n FROM e GROUP BY 1, 2, 3),
c AS (SELECT workspace, term, sum(n)::BIGINT AS count FROM p GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY score DESC, count DESC, term) AS place FROM (SELECT workspace, term, count, round(count * ln((1.0 + g) / (1.0 + df)), 9) AS score FROM c JOIN f USING (term), (SELECT count(DISTINCT workspace) AS g FROM toks WHERE authored_by = 'human') WHERE count >= 3) QUALIFY place <= 3
""")
def project_terms_tfidf(spark, sf_dir):
    return report.distinctive_terms(_toks(spark, sf_dir), "workspace")


@query("topic_terms", f"""
WITH t AS (SELECT ordinal_ % 4 AS topic, toks FROM (SELECT toks, regexp_extract(item_id, '-([0-9]+)$', 1)::INT AS ordinal_ FROM toks WHERE authored_by = 'human')),
e AS (SELECT topic, unnest(list_distinct(list_filter(toks, lambda w : strlen(w) > 2 AND NOT list_contains({_stop(text.STOPWORDS)}, w)))) AS term FROM t),
c AS (SELECT topic, term, count(*) AS count FROM e GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, count DESC, term) AS place FROM (SELECT topic, term, count, round(count * ln((1.0 + g) / (1.0 + df)), 9) AS score FROM c JOIN f USING (term), (SELECT count(DISTINCT topic) AS g FROM t)) QUALIFY place <= 12
""")
def topic_terms(spark, sf_dir):
    rows = _toks(spark, sf_dir).withColumn("topic", F.regexp_extract("item_id", r"-(\d+)$", 1).cast("int") % 4)
    return report.topic_terms(rows, "topic")


@query("model_slices", """
WITH b AS (SELECT 'model-' || ((conv_id % 13) % 9) AS name, count(*) AS sessions FROM facts GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY sessions DESC, name) AS place, count(*) OVER () AS models FROM b),
f AS (SELECT CASE WHEN models > 5 AND place >= 5 THEN 'other models' ELSE name END AS name, sum(sessions)::BIGINT AS sessions FROM r GROUP BY 1)
SELECT *, round(sessions / sum(sessions) OVER (), 9) AS share FROM f
""")
def model_slices(spark, sf_dir):
    facts = model.facts(spark, sf_dir).withColumn("primary_model", F.concat(F.lit("model-"), (F.col("conv_id") % 13) % 9))
    return report.model_slices(facts).withColumn("share", F.round("share", 9))


def _annotations(spark, sf_dir):
    labels = cluster.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.explode(F.array(F.struct(F.lit("quality").alias("axis"), (F.col("quality") * 3 + 1).alias("score")), F.struct(F.lit("toxic").alias("axis"), (F.col("toxic") * 2 + 2).alias("score")))).alias("a"))
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("annotator_version"), F.lit(f"2024-0{k}-01").cast("timestamp").alias("annotated_at")) for k, v in ((1, "v1"), (2, "v2"))])).alias("v")
    # the later version is not complete
    return labels.select("item_id", "a.*", versions).select("item_id", "axis", "score", "v.*").filter("not (annotator_version = 'v2' and item_id % 11 = 0)")


_ANNOTATIONS = """
n AS (SELECT doc_id AS item_id, axis, CASE axis WHEN 'quality' THEN quality * 3 + 1 ELSE toxic * 2 + 2 END AS score, annotator_version, annotated_at
  FROM labels, (VALUES ('quality'), ('toxic')) x(axis), (VALUES ('v1', TIMESTAMP '2024-01-01'), ('v2', TIMESTAMP '2024-02-01')) v(annotator_version, annotated_at) WHERE NOT (annotator_version = 'v2' AND doc_id % 11 = 0))"""


@query("sentiment_week_axis", f"""
WITH {_ANNOTATIONS}, k AS (SELECT count(*) AS corpus FROM labels),
v AS (SELECT annotator_version FROM n GROUP BY 1 HAVING count(*) = (SELECT corpus FROM k) * 2 AND count(DISTINCT item_id) = (SELECT corpus FROM k) ORDER BY max(annotated_at) DESC, annotator_version DESC LIMIT 1)
SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(item_id), '%Y-%W') AS week, axis, round(avg(score), 9) AS score, count(*) AS messages FROM n JOIN v USING (annotator_version) GROUP BY 1, 2
""")
def sentiment_week_axis(spark, sf_dir):
    rows = _annotations(spark, sf_dir)
    corpus = cluster.table(spark, sf_dir, "labels").count()
    chosen = rows.join(F.broadcast(report.sentiment_version(rows, corpus, 2)), "annotator_version")
    at = F.timestamp_add("HOUR", F.col("item_id").cast("int"), F.lit(model.EPOCH).cast("timestamp"))
    return report.sentiment_periods(chosen, {"week": dates.monday_week(at)}).withColumn("score", F.round("score", 9))


@query("annotation_completeness", f"""
WITH {_ANNOTATIONS} SELECT annotator_version, count(DISTINCT item_id) AS items, count(*) AS rows_written, count(DISTINCT item_id) FILTER (axes = 2) AS complete
FROM (SELECT *, count(*) OVER (PARTITION BY annotator_version, item_id) AS axes FROM n) GROUP BY 1
""")
def annotation_completeness(spark, sf_dir):
    by = _annotations(spark, sf_dir).groupBy("annotator_version", "item_id").agg(F.count("*").alias("axes"))
    return by.groupBy("annotator_version").agg(F.count("*").alias("items"), F.sum("axes").alias("rows_written"), F.count_if(F.col("axes") == 2).alias("complete"))


@query("thread_today_counts", """
SELECT session_id, coalesce(n, 0) AS today FROM facts LEFT JOIN (SELECT session_id, count(*) AS n FROM items WHERE tier = 'conversation' AND occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-03' GROUP BY 1) t USING (session_id)
""")
def thread_today_counts(spark, sf_dir):
    day = F.date_trunc("day", F.lit("2024-01-02 10:30:00").cast("timestamp"))
    counts = model.items(spark, sf_dir).filter((F.col("tier") == "conversation") & (F.col("occurred_at") >= day) & (F.col("occurred_at") < day + F.expr("INTERVAL 1 DAY"))).groupBy("session_id").agg(F.count("*").alias("n"))
    return model.facts(spark, sf_dir).join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("today"))
