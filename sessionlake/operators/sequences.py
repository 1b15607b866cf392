"""Ordered operators: carrying forward, islands, running positions, first signals, paging."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake import cluster


def carry_model(rows: DataFrame, by: str, order: list[str], value: str, to: str = "carried_model") -> DataFrame:
    """Adds the last non-blank value up to and including each row."""
    filled = F.when(F.trim(F.col(value)) != "", F.col(value))
    window = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(to, F.last(filled, ignorenulls=True).over(window))


def allocate(rows: DataFrame, by: str, weight: str, total: str, to: str = "allocated") -> DataFrame:
    """Deals out a group's total by the weights of its rows."""
    return rows.withColumn(to, F.col(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy(by)))


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, first, last): runs of consecutive numbers; repeated numbers count once."""
    order = Window.partitionBy(*by).orderBy(number)
    return rows.select(*by, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(order)).groupBy(*by, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def offsets(rows: DataFrame, by: list[str], order: list[str], size: str, to: str = "offset") -> DataFrame:
    """Adds where each row's bytes begin."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(to, F.coalesce(F.sum(size).over(window), F.lit(0)))


def contiguous(rows: DataFrame, by: list[str], order: list[str], offset: str, size: str, full: str) -> DataFrame:
    """(by, ok): whether each entry begins where the one before ends, the first at zero, and all fill the full size."""
    window = Window.partitionBy(*by).orderBy(*order)
    expected = F.coalesce(F.lag(F.col(offset) + F.col(size)).over(window), F.lit(0))
    return rows.withColumn("_fits", F.col(offset) == expected).groupBy(*by).agg((F.bool_and("_fits") & (F.sum(size) == F.max(full))).alias("ok"))


def first_signal(events: DataFrame, by: str, order: str, kind: str, signal: str, leading: str, default: str) -> DataFrame:
    """(by, signal): the first signal of events of the leading kind; of any events where there are none of it; else a default."""
    lead = F.col(kind) == leading
    return events.groupBy(by).agg(F.min_by(signal, F.when(lead & F.col(signal).isNotNull(), F.col(order))).alias("_lead"), F.bool_or(lead).alias("_has"), F.min_by(signal, F.when(F.col(signal).isNotNull(), F.col(order))).alias("_any")).select(by, F.coalesce(F.when(F.col("_has"), F.col("_lead")).otherwise(F.col("_any")), F.lit(default)).alias(signal))


def context(items: DataFrame, by: str, order: list[str], target: Column, before: int, after: int) -> DataFrame:
    """Rows around each group's anchor: the first row that is the target, else the last row of the group. Adds place, from -before to after."""
    ranked = items.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    whole = Window.partitionBy(by)
    anchored = ranked.withColumn("_a", F.coalesce(F.min(F.when(target, F.col("_n"))).over(whole), F.max("_n").over(whole)))
    return anchored.withColumn("place", F.col("_n") - F.col("_a")).filter(F.col("place").between(-before, after)).drop("_n", "_a")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], most: int, to: str = "place") -> DataFrame:
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(to) <= most)


def numbered(keys: DataFrame, order: list[str], to: str = "_n") -> tuple[DataFrame, int]:
    """(keys with their places from 0 in a global order, how many there are), without one task for all.

    The keys are range-partitioned and written; a place is the one in its
    partition plus the sizes of the partitions before, one number for each.
    """
    sorted_ = cluster.materialize(keys.select(*order).orderBy(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = {r["_p"]: r["count"] for r in sorted_.groupBy("_p").count().collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = keys.sparkSession.createDataFrame(before, "_p int, _b long")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return sorted_.withColumn("_o", own).join(F.broadcast(starts), "_p").select(*order, (F.col("_b") + F.col("_o") - 1).alias(to)), total


def stride_sample(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """count rows at even strides of an order: those of place i * n // count for each i; all rows if there are no more."""
    keys, total = numbered(rows, order)
    if total <= count:
        return rows
    i = F.ceil(F.col("_n") * count / F.lit(total))
    chosen = keys.filter((F.floor(i * F.lit(total) / count) == F.col("_n")) & (i < count))
    return rows.join(chosen.select(*order), order, "left_semi")


def page(rows: DataFrame, order: list[str], size: int, cursor: str | None = None) -> DataFrame:
    """A page of rows in keyset order, nulls first, and one row more if there are others. cursor: of the row before."""
    if cursor:
        last = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        beyond, same = F.lit(False), F.lit(True)
        for name in order:
            value = F.lit(last[name]).cast(rows.schema[name].dataType)
            beyond |= same & ((F.col(name) > value) if last[name] is not None else F.col(name).isNotNull())
            same &= F.col(name).eqNullSafe(value)
        rows = rows.filter(beyond)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size + 1)


def cursor(row: dict, order: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps({c: str(row[c]) if row[c] is not None else None for c in order}).encode()).decode()
