"""Time series and panel transforms as windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: Sequence[str]):  # noqa: ANN201
    return W.partitionBy(*keys).orderBy(*order)


def last_in_period(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each group; order must be unique in a group."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def log_change(value: Column, window, lag: int = 1) -> Column:  # noqa: ANN001
    """log x - log x[-lag]; null where either isn't positive."""
    return F.ln(value) - F.lag(F.ln(value), lag).over(window)


def calendar_lag(value: str, index: str, window) -> Column:  # noqa: ANN001
    """The value one month before; null if that month is missing, unlike a row lag."""
    return F.when(F.col(index) - F.lag(index).over(window) == 1, F.lag(value).over(window))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w*x by sum of w, over rows with both."""
    ok = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(ok, w * x)), F.sum(F.when(ok, w)))


def compounded(r: Column) -> Column:
    return F.product(1 + r) - 1


def demeaned(x: str, *keys: str) -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(*keys))


def prior_mean(x: str, keys: list[str], order: str, least: int) -> Column:
    """Mean of the earlier rows of the group, null with fewer than `least`."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def quantile_bucket(df: DataFrame, x: str, keys: list[str], n: int, name: str) -> DataFrame:
    """Bucket 1..n of x within keys by exact quantiles (linear interpolation), right-closed, the least value in bucket 1."""
    cuts = df.groupBy(*keys).agg(F.percentile(x, [i / n for i in range(1, n)]).alias("_cuts"))
    bucket = F.lit(1) + F.size(F.filter("_cuts", lambda c: F.col(x) > c))
    return df.join(cuts, keys).withColumn(name, F.when(F.col(x).isNotNull(), bucket)).drop("_cuts")


def average_rank(x: str, *keys: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count("*").over(W.partitionBy(*keys, x)) - 1) / 2


def filled_grid(axes: Sequence[DataFrame], facts: DataFrame, on: list[str], fill: dict[str, int]) -> DataFrame:
    """All combinations of the axes (small dimension tables) with the facts' values, or the fill."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.join(axis)
    return grid.join(facts, on, "left").fillna(fill)


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value of each group, the least one at a tie."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return first_match(n, keys, F.desc("_n"), F.col(value)).select(*keys, F.col(value).alias(name))


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Adds p_adjusted: p values adjusted within keys; a larger p never gets a smaller one, none exceeds 1. ties orders equal p values."""
    w = W.partitionBy(*keys)
    scaled = df.withColumn("_q", F.count(p).over(w) * F.col(p) / F.row_number().over(w.orderBy(p, *ties)))
    down = w.orderBy(F.desc(p), *(F.desc(t) for t in ties)).rowsBetween(W.unboundedPreceding, 0)
    return scaled.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q")


def first_match(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by order (to be unique)."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def verdict(p: Column) -> Column:
    return F.when(p < 0.05, "significant").when(p < 0.10, "marginal").otherwise("not significant")
