"""Joins of points with intervals: point-in-time sums, latest active interval, validity of dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.dates import month


def active_at(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval that holds it (closed).

    Both sides are binned by month, so it is an equi-join with the bounds as a residual test: no nested loop, whatever the
    sizes. An interval has one row per month that it touches.
    """
    binned = intervals.withColumn("_bin", F.explode(F.sequence(month(F.col(start)), month(F.col(end)), F.expr("interval 1 month"))))
    return points.withColumn("_bin", month(F.col(at))).join(binned, "_bin").filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def latest_active(pairs: DataFrame, point: list[str], start: str, ties: list[str], values: list[str]) -> DataFrame:
    """Of a point's intervals the one that started last (the larger ties among equals)."""
    best = F.max_by(F.struct(*values), F.struct(start, *ties)).alias("v")
    return pairs.groupBy(*point).agg(best).select(*point, *(F.col(f"v.{c}").alias(c) for c in values))


def latest_spells(intervals: DataFrame, group: list[str], start: str, end: str, ties: list[str], value: str) -> DataFrame:
    """Adds the days (first, last) on which an interval is its group's latest active one: latest_active without the points.

    An interval without a value has the days that no other one holds. Intervals that start later must not end earlier. Spells are
    disjoint, so they add up over groups without pairs of points and intervals; one with no days has first > last or a null.
    """
    w = W.partitionBy(*group).orderBy(start, *ties)
    back = W.partitionBy(*group).orderBy(*(F.desc(c) for c in (start, *ties)))
    has = F.col(value).isNotNull()
    nearest = lambda column, window: F.last(F.when(has, F.col(column)), ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))
    to = F.least(end, F.date_sub(nearest(start, back), 1))
    bare_from, bare_to = F.greatest(start, F.date_add(nearest(end, w), 1)), F.least(to, F.date_sub(F.lead(start).over(w), 1))
    known = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    return known.select("*", F.when(has, F.col(start)).otherwise(bare_from).alias("first"), F.when(has, to).otherwise(bare_to).alias("last"))


def daily_sums(intervals: DataFrame, start: str, end: str, values: list[str], day: str) -> DataFrame:
    """Sums of `values` over the intervals that hold each day (closed), for every day that any holds.

    Intervals are cut into aligned blocks of 1, 2, 4, ... days, at most two of a size, and summed by block; only those sums are spread
    over days. So no interval is spread over its days, and nothing is subtracted: sums of doubles don't drift.
    """
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.datediff(end, start) + 1)).cast("int"))
    cut = intervals.filter(F.col(start) <= F.col(end)).select(*values, F.unix_date(start).alias("_a"), (F.unix_date(end) + 1).alias("_b"), F.explode(sizes).alias("_size"))
    cut = cut.withColumns({"_a": F.expr("shiftright(_a + shiftleft(1, _size) - 1, _size)"), "_b": F.expr("shiftright(_b, _size)")}).filter("_a < _b")
    ends = F.array(F.when(F.col("_a").bitwiseAND(1) == 1, F.col("_a")), F.when(F.col("_b").bitwiseAND(1) == 1, F.col("_b") - 1))
    sums = [F.sum(v).alias(v) for v in values]
    blocks = cut.select(*values, "_size", F.explode(ends).alias("_block")).filter("_block IS NOT NULL").groupBy("_size", "_block").agg(*sums)
    days = F.expr("sequence(shiftleft(_block, _size), shiftleft(_block + 1, _size) - 1)")
    return blocks.select(*values, F.explode(days).alias("_day")).groupBy(F.date_from_unix_date("_day").alias(day)).agg(*sums)


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """Closed validity; a null bound is open."""
    return (start.isNull() | (at >= start)) & (end.isNull() | (at <= end))


def edges(intervals: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Two rows per interval: its start and its end."""
    return intervals.withColumn(name, F.explode(F.array(F.col(start), F.col(end))))
