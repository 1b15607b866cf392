"""Usage reports. Everything that a report would read from the clock is a parameter (as_of)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import dates, text

# What a change, a daypart or a month needs to be told.
CHANGE_MESSAGES, CHANGE_DIFFERENCE, CHANGE_PERCENT, CHANGES_TOLD = 20, 5, 20, 2
DAYPART_MESSAGES, DAYPART_LIFT, DAYPART_GAP = 50, 1.25, 5.0
SUMMARY_MESSAGES, SUMMARY_MONTHS, MODEL_MESSAGES, MODELS_TOLD = 2000, 6, 150, 5


def between(column: Column, after: str | None, before: str | None) -> Column:
    """after inclusive, before exclusive; a null time is inside no set bound."""
    wanted = F.lit(True)
    if after is not None:
        wanted &= column >= F.lit(after).cast("timestamp")
    if before is not None:
        wanted &= column < F.lit(before).cast("timestamp")
    return wanted


def overlaps(first: Column, last: Column, after: str | None, before: str | None) -> Column:
    """Sessions that a period touches."""
    wanted = F.lit(True)
    if after is not None:
        wanted &= last >= F.lit(after).cast("timestamp")
    if before is not None:
        wanted &= first < F.lit(before).cast("timestamp")
    return wanted


def totals(facts: DataFrame, provenance: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """One row: sessions, threads, events, first and last activity, and messages by author."""
    chosen = facts.filter(overlaps(F.col("first_event_at"), F.col("last_event_at"), after, before))
    authors = ["human", "agent", "assistant", "harness"]
    by_session = provenance.groupBy("session_id").agg(*[F.count_if(F.col("authored_by") == a).alias(a) for a in authors])
    return chosen.join(by_session, "session_id", "left").agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("session_class") != "subagent").alias("threads"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"),
        F.min("first_event_at").alias("first_activity"),
        F.max("last_event_at").alias("last_activity"),
        *[F.coalesce(F.sum(a), F.lit(0)).alias(f"{a}_messages") for a in authors],
    )


def calendar(facts: DataFrame, provenance: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """(day, sessions, human_messages) of the last days up to as_of, days without any included."""
    spark = facts.sparkSession
    last = F.to_date(F.lit(as_of))
    every = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    sessions = facts.groupBy(F.to_date("first_event_at").alias("day")).agg(F.count("*").alias("sessions"))
    human = provenance.filter("authored_by = 'human'").groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("human_messages"))
    return every.join(sessions, "day", "left").join(human, "day", "left").select("day", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("human_messages", F.lit(0)).alias("human_messages"))


def calendar_levels(days: DataFrame, count: str = "sessions") -> DataFrame:
    """Adds level: 0 for none, else the quartile of the day's count among days that have any. days holds a row per day of a bounded period."""
    some = days.filter(F.col(count) > 0).groupBy(count).agg(F.count("*").alias("n"))
    share = some.select(count, (F.sum("n").over(Window.orderBy(count)) / F.sum("n").over(Window.partitionBy())).alias("share"))
    return days.join(F.broadcast(share), count, "left").withColumn("level", F.coalesce(F.ceil(F.col("share") * 4).cast("int"), F.lit(0))).drop("share")


def _period(ts: Column, as_of: Column, days: int) -> Column:
    """current, previous or null: the two windows of so many days before as_of."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return F.when((age >= 0) & (age < days * 86400), "current").when((age >= days * 86400) & (age < 2 * days * 86400), "previous")


def percent_change(current: Column, previous: Column) -> Column:
    """Rounded half away from zero; null if there was nothing before."""
    return F.when(previous != 0, F.round((current - previous) * 100.0 / previous).cast("long"))


def comparison(facts: DataFrame, provenance: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """(days, metric, current, previous, percent): sessions, human messages and tokens of each window against the one before."""
    now = F.lit(as_of).cast("timestamp")
    tokens = sum((F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in map(F.col, ("input_tokens", "cached_input_tokens", "output_tokens"))), F.lit(0))
    parts = [facts.select(F.col("first_event_at").alias("ts"), F.lit("sessions").alias("metric"), F.lit(1).cast("long").alias("n")), provenance.filter("authored_by = 'human'").select(F.col("occurred_at").alias("ts"), F.lit("human_messages"), F.lit(1).cast("long")), facts.select(F.col("last_event_at"), F.lit("tokens"), tokens.cast("long"))]
    every = parts[0].union(parts[1]).union(parts[2])
    spread = every.select("metric", "n", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), _period(F.col("ts"), now, d).alias("period")) for d in windows])).alias("w")).filter("w.period is not null")
    summed = spread.groupBy("w.days", "metric").agg(F.sum(F.when(F.col("w.period") == "current", F.col("n")).otherwise(0)).alias("current"), F.sum(F.when(F.col("w.period") == "previous", F.col("n")).otherwise(0)).alias("previous"))
    return summed.withColumn("percent", percent_change(F.col("current"), F.col("previous")))


def project_changes(provenance: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """(days, project, current, previous, score): the projects whose human messages changed most in each window."""
    now = F.lit(as_of).cast("timestamp")
    human = provenance.filter("authored_by = 'human'").select("workspace", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), _period(F.col("occurred_at"), now, d).alias("period")) for d in windows])).alias("w")).filter("w.period is not null")
    summed = human.groupBy("w.days", text.path_label(F.col("workspace")).alias("project")).agg(F.count_if(F.col("w.period") == "current").alias("current"), F.count_if(F.col("w.period") == "previous").alias("previous"))
    percent = percent_change(F.col("current"), F.col("previous"))
    both = F.col("current") + F.col("previous")
    told = summed.withColumn("percent", percent).filter((both >= CHANGE_MESSAGES) & (F.abs(F.col("current") - F.col("previous")) >= CHANGE_DIFFERENCE) & ((F.col("previous") == 0) | (F.abs("percent") >= CHANGE_PERCENT)))
    scored = told.withColumn("score", F.when(F.col("previous") == 0, both * 100).otherwise(F.abs("percent")))
    order = Window.partitionBy("days").orderBy(F.desc("score"), "project")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CHANGES_TOLD).select("days", "project", "current", "previous", "percent", "score", "place")


def tokens_by_day(facts: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    kinds = ["input_tokens", "cached_input_tokens", "output_tokens"]
    return facts.filter(F.col("last_event_at").isNotNull() & between(F.col("last_event_at"), after, before)).groupBy(F.to_date("last_event_at").alias("day")).agg(*[F.greatest(F.coalesce(F.sum(k), F.lit(0)), F.lit(0)).alias(k) for k in kinds])


def tokens_by_model(facts: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    total = sum((F.coalesce(c, F.lit(0)) for c in map(F.col, ("input_tokens", "cached_input_tokens", "output_tokens"))), F.lit(0))
    return facts.filter(between(F.col("last_event_at"), after, before)).groupBy(F.coalesce("primary_model", F.lit("unknown")).alias("model")).agg(F.sum(total).alias("tokens")).filter("tokens > 0").orderBy(F.desc("tokens"), "model")


def projects(facts: DataFrame, provenance: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """By workspace: a null one and one named unknown stay apart; total_tokens is null if no session has any."""
    human = provenance.filter("authored_by = 'human'").groupBy("session_id").agg(F.count("*").alias("human"))
    kinds = [F.col(k) for k in ("input_tokens", "cached_input_tokens", "output_tokens")]
    used = F.coalesce(*kinds).isNotNull()
    total = sum((F.coalesce(k, F.lit(0)) for k in kinds), F.lit(0))
    chosen = facts.filter(overlaps(F.col("first_event_at"), F.col("last_event_at"), after, before)).join(human, "session_id", "left")
    return chosen.groupBy("workspace").agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("human"), F.lit(0)).alias("human_messages"), F.sum(F.when(used, total)).alias("total_tokens"), F.coalesce(F.sum("duration_secs"), F.lit(0)).alias("duration_secs"), F.max("last_event_at").alias("last_activity")
    ).withColumn("project", text.path_label(F.col("workspace")))


def mix_by_month(facts: DataFrame, by: str) -> DataFrame:
    """(month, name, sessions) by a column of facts, blank names left out."""
    return facts.filter(F.trim(F.col(by)) != "").filter("first_event_at is not null").groupBy(dates.month(F.col("first_event_at")).alias("month"), F.col(by).alias("name")).agg(F.count("*").alias("sessions"))


def rhythms(provenance: DataFrame) -> DataFrame:
    """(axis, label, human_messages) by hour and by weekday: one aggregation by both, rolled up twice by grouping sets."""
    both = provenance.filter("authored_by = 'human' and occurred_at is not null").groupBy(dates.hour(F.col("occurred_at")).alias("hour"), dates.weekday(F.col("occurred_at")).cast("string").alias("weekday")).agg(F.count("*").alias("n"))
    sets = both.groupingSets([["hour"], ["weekday"]], "hour", "weekday").agg(F.sum("n").alias("human_messages"), F.grouping("hour").alias("_g"))
    return sets.select(F.when(F.col("_g") == 0, "hour").otherwise("weekday").alias("axis"), F.when(F.col("_g") == 0, F.col("hour")).otherwise(F.col("weekday")).alias("label"), "human_messages")


def dayparts(provenance: DataFrame) -> DataFrame:
    """Morning, afternoon and evening with their shares and what even hours would give; all three are always there."""
    spark = provenance.sparkSession
    parts = spark.createDataFrame([("morning", 0, 11, 12), ("afternoon", 12, 16, 5), ("evening", 17, 23, 7)], "label string, first int, last int, hours int")
    counted = provenance.filter("authored_by = 'human' and occurred_at is not null").groupBy(F.hour("occurred_at").alias("hour")).agg(F.count("*").alias("n"))
    joined = F.broadcast(parts).join(counted, (F.col("hour") >= F.col("first")) & (F.col("hour") <= F.col("last")), "left").groupBy("label", "hours").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("human_messages"))
    every = F.greatest(F.sum("human_messages").over(Window.partitionBy()), F.lit(1))
    return joined.select("label", "human_messages", (F.col("human_messages") * 100.0 / every).alias("share_percent"), (F.col("hours") * 100.0 / 24).alias("baseline_percent"))


def daypart_insights(parts: DataFrame) -> DataFrame:
    lift = F.col("share_percent") / F.col("baseline_percent")
    return parts.withColumn("lift", lift).filter((F.col("human_messages") >= DAYPART_MESSAGES) & (F.col("lift") >= DAYPART_LIFT) & (F.col("share_percent") - F.col("baseline_percent") >= DAYPART_GAP)).orderBy(F.desc("lift"), "label").limit(2)


def frustration(messages: DataFrame, facts: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(month, model, matches, messages, hours) of human messages with a model: those with a frustrated word, all, and their share of their sessions' time.

    A session's duration is dealt out by its messages' months and models.
    messages: session_id, occurred_at, model, and toks, the words of the text.
    """
    wanted = F.array(*map(F.lit, terms or text.FRUSTRATION))
    by = messages.groupBy("session_id", dates.month(F.col("occurred_at")).alias("month"), "model").agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("toks", wanted)).alias("matches"))
    whole = F.sum("n").over(Window.partitionBy("session_id"))
    dealt = by.withColumn("whole", whole).join(facts.select("session_id", "duration_secs"), "session_id", "left").withColumn("secs", F.coalesce("duration_secs", F.lit(0)) * F.col("n") / F.col("whole"))
    return dealt.groupBy("month", "model").agg(F.sum("matches").alias("matches"), F.sum("n").alias("messages"), F.round(F.sum("secs")).cast("long").alias("duration_secs"))


def merged_months(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """Two tables by month and model as one; what a side lacks is zero."""
    return matches.join(counts, ["month", "model"], "full").select("month", "model", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("messages", F.lit(0)).alias("messages"))


def frustration_summary(points: DataFrame, filtered: bool = False, full: bool = False) -> DataFrame:
    """(model, matches, messages, duration_secs, per_hour, delta) over the newest months that give SUMMARY_MESSAGES messages or are SUMMARY_MONTHS.

    per_hour is null without a duration; delta is against the rate of all
    models together, zero if less than 0.005. Calmest first, models without a
    rate last. A filtered or full summary has all months; only a full one tells
    of models with few messages and of more than MODELS_TOLD. points holds one
    row per month and model, so the running sum is over months.
    """
    chosen = points
    if not (filtered or full):
        newest = Window.orderBy(F.desc("month"))
        before = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        months = points.groupBy("month").agg(F.sum("messages").alias("n")).withColumn("before", before).withColumn("place", F.row_number().over(newest))
        chosen = points.join(F.broadcast(months.filter((F.col("before") < SUMMARY_MESSAGES) & (F.col("place") <= SUMMARY_MONTHS)).select("month")), "month")
    rate = lambda matches, secs: F.when(secs > 0, matches * 3600.0 / secs)
    every = Window.partitionBy()
    by = chosen.groupBy("model").agg(F.sum("matches").alias("matches"), F.sum("messages").alias("messages"), F.sum("duration_secs").alias("duration_secs"))
    rated = by.withColumn("per_hour", rate(F.col("matches"), F.col("duration_secs"))).withColumn("_delta", F.col("per_hour") - rate(F.sum("matches").over(every), F.sum("duration_secs").over(every)))
    told = (rated if full else rated.filter(F.col("messages") >= MODEL_MESSAGES)).withColumn("delta", F.when(F.abs("_delta") < 0.005, 0.0).otherwise(F.col("_delta"))).drop("_delta")
    sorted_ = told.orderBy(F.asc_nulls_last("per_hour"), F.desc("matches"), "model")
    return sorted_ if full else sorted_.limit(MODELS_TOLD)


def ngrams(toks: DataFrame, n: int, least: int = 3, most: int = 20, per_message: int = 3) -> DataFrame:
    """The most frequent n-grams of messages (item_id, toks): each counts at most per_message times in one.

    Single words have more than one byte and are no stopwords; longer ones have
    at least one word that is not.
    """
    stop = F.array(*map(F.lit, text.STOPWORDS))

    def grams(own: Column) -> Column:
        size = F.size(own) - n + 1
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.slice(own, k, n)))

    # bound by a lambda, so that no plan works out toks anew for each position
    every = F.element_at(F.transform(F.array("toks"), grams), 1)
    wanted = F.filter(every, lambda g: (F.octet_length(g[0]) > 1) & ~F.array_contains(stop, g[0])) if n == 1 else F.filter(every, lambda g: F.exists(g, lambda w: ~F.array_contains(stop, w)))
    counted = toks.select("item_id", F.explode(F.transform(wanted, lambda g: F.array_join(g, " "))).alias("term")).groupBy("item_id", "term").agg(F.least(F.count("*"), F.lit(per_message)).alias("n"))
    return counted.groupBy("term").agg(F.sum("n").alias("count")).filter(F.col("count") >= least).orderBy(F.desc("count"), "term").limit(most)


def distinctive_terms(toks: DataFrame, by: str, least: int = 3, most: int = 3, per_message: int = 3) -> DataFrame:
    """The terms of each group that are frequent there and rare elsewhere: count * ln((1 + groups) / (1 + groups with it))."""
    noise = F.array(*map(F.lit, text.STOPWORDS + text.PROJECT_NOISE))
    single = F.filter("toks", lambda w: (F.octet_length(w) > 2) & ~F.array_contains(noise, w))
    per_item = toks.select(by, "item_id", F.explode(single).alias("term")).groupBy(by, "item_id", "term").agg(F.least(F.count("*"), F.lit(per_message)).alias("n"))
    return _distinctive(per_item.groupBy(by, "term").agg(F.sum("n").alias("count")), toks.select(by).distinct(), by, least, most)


def topic_terms(toks: DataFrame, by: str, most: int = 12) -> DataFrame:
    """As distinctive_terms, over the messages of each group that hold a term."""
    noise = F.array(*map(F.lit, text.STOPWORDS))
    single = F.array_distinct(F.filter("toks", lambda w: (F.octet_length(w) > 2) & ~F.array_contains(noise, w)))
    return _distinctive(toks.select(by, F.explode(single).alias("term")).groupBy(by, "term").agg(F.count("*").alias("count")), toks.select(by).distinct(), by, 1, most)


def _distinctive(counts: DataFrame, every: DataFrame, by: str, least: int, most: int) -> DataFrame:
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = every.agg(F.count("*").alias("groups"))  # one row
    scored = counts.join(spread, "term").crossJoin(F.broadcast(n)).filter(F.col("count") >= least).withColumn("score", F.round(F.col("count") * F.log((1.0 + F.col("groups")) / (1.0 + F.col("df"))), 9))
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("count"), "term")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(by, "term", "count", "score", "place")


def model_slices(facts: DataFrame, most: int = 5) -> DataFrame:
    """(name, sessions, share): models by sessions; of more than `most`, the smaller ones together."""
    by = facts.filter(F.trim("primary_model") != "").groupBy(F.col("primary_model").alias("name")).agg(F.count("*").alias("sessions"))
    order = Window.orderBy(F.desc("sessions"), "name")
    ranked = by.withColumn("place", F.row_number().over(order)).withColumn("models", F.count("*").over(Window.partitionBy()))
    folded = ranked.withColumn("name", F.when((F.col("models") > most) & (F.col("place") >= most), "other models").otherwise(F.col("name"))).groupBy("name").agg(F.sum("sessions").alias("sessions"))
    return folded.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy()))


def sentiment_version(annotations: DataFrame, corpus: int, axes: int) -> DataFrame:
    """(annotator_version): the latest that annotates every item of the corpus on every axis."""
    whole = annotations.groupBy("annotator_version").agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"), F.max("annotated_at").alias("at"))
    return whole.filter((F.col("rows") == corpus * axes) & (F.col("items") == corpus)).orderBy(F.desc("at"), F.desc("annotator_version")).limit(1).select("annotator_version")


def sentiment_periods(annotations: DataFrame, by: dict[str, Column]) -> DataFrame:
    return annotations.groupBy(*[c.alias(n) for n, c in by.items()], "axis").agg(F.avg("score").alias("score"), F.count("*").alias("messages"))


def snapshot(parts: dict[str, DataFrame], generated_at: str) -> DataFrame:
    """(report_json, generated_at): one row that holds all parts of a report as arrays of objects. Parts are reports, so they are small."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    listed = out.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "rows"))), lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["rows"])), ",").alias("_all"))
    return listed.select(F.concat(F.lit("{"), "_all", F.lit("}")).alias("report_json"), F.lit(generated_at).cast("timestamp").alias("generated_at"))
