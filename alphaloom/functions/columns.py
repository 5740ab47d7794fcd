"""Column expressions used all over: guarded correlation, average ranks, windows, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ts(*extra: str):
    """Rows of a ticker (and of ``extra`` keys) in date order."""
    return Window.partitionBy(*extra, "ticker").orderBy("date")


def last_rows(n: int, *extra: str):
    return ts(*extra).rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column, *extra: str, least: int | None = None) -> Column:
    """``value`` where the last ``n`` rows hold at least ``least`` (all, by default) values of x, else null."""
    return F.when(F.count(x).over(last_rows(n, *extra)) >= (least or n), value)


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of an aggregation over rows where both are there; null where one is constant."""
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def daily_ic(x: Column, y: Column) -> Column:
    """A day's correlation: null under two rows or with a constant target, 0 with a constant signal."""
    return (
        F.when(F.count(x) < 2, F.lit(None).cast("double"))
        .when(F.min(x) == F.max(x), F.lit(0.0))
        .when(F.min(y) == F.max(y), F.lit(None).cast("double"))
        .otherwise(safe_corr(x, y))
    )


def average_rank(x: Column, *keys) -> Column:
    """Rank from 1 inside ``keys``, ties sharing their mean rank, nulls last (and ranked; guard them outside).

    The mean of the first and the last place of the ties, both from windows of one order: one sort, and no partitioning by value.
    """
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0


def pct_rank(x: Column, *keys) -> Column:
    return F.when(x.isNotNull(), average_rank(x, *keys) / F.count(x).over(Window.partitionBy(*keys)))


def ordinal_norm(x: Column, *keys) -> Column:
    """Ordinal rank (ties by ticker) spread over [-0.5, 0.5]; a lone value is 0."""
    w = Window.partitionBy(*keys)
    n = F.count(x).over(w)
    place = F.row_number().over(w.orderBy(x.asc_nulls_last(), "ticker")) - 1
    return F.when(x.isNotNull(), F.when(n < 2, F.lit(0.0)).otherwise(F.try_divide(place.cast("double"), (n - 1).cast("double")) - 0.5))


#: A row's number in its series, from 0; what ``decayed_sum`` needs beside ``ticker`` and ``date``.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with each row's number among its ticker's rows."""
    return df.withColumn(ROW, F.row_number().over(ts()) - 1)


def decayed_sum(x: Column, keep: float) -> Column:
    """The sum of ``x`` over this row and all before it, each times ``keep`` to the power of its age in rows; nulls are 0, rows are ``numbered``.

    Series are cut into chunks long enough for what is older than the chunk before to weigh under 1e-18. In a pair of
    neighbouring chunks the terms, scaled by their place, have a running sum, which this row's place scales back. Pairs
    begin at even or at odd chunks, and a row takes the pair in which its chunk is second. So a row costs the same for any ``keep``.
    """
    rate = -math.log(keep)
    span = max(2, math.ceil(42 / rate))
    chunk = F.floor(F.col(ROW) / span)

    def running(shift: int) -> Column:
        pair = F.floor((chunk + shift) / 2)
        place = (F.col(ROW) - (2 * pair - shift) * span).cast("double")
        w = Window.partitionBy("ticker", pair).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(F.coalesce(x.cast("double"), F.lit(0.0)) * F.exp(place * rate)).over(w) * F.exp(-place * rate)

    return F.when(chunk % 2 == 1, running(0)).otherwise(running(1))


def ewm_mean(x: Column, span: float) -> Column:
    """Exponentially weighted mean at each ``numbered`` row; nulls keep decaying the past."""
    keep = 1 - 2.0 / (span + 1)
    return F.try_divide(decayed_sum(x, keep), F.nullif(decayed_sum(F.when(x.isNotNull(), 1.0), keep), F.lit(0.0)))


def ewm_std(x: Column, span: float) -> Column:
    """Bias-corrected exponentially weighted standard deviation at each ``numbered`` row; nulls keep decaying the past.

    From sums of powers: what is left of squares under a trillionth of their sum counts as none.
    """
    keep = 1 - 2.0 / (span + 1)
    there = F.when(x.isNotNull(), 1.0)
    w, w2 = F.nullif(decayed_sum(there, keep), F.lit(0.0)), decayed_sum(there, keep * keep)
    first, second = decayed_sum(x, keep), decayed_sum(x * x, keep)
    left = second - F.try_divide(first * first, w)
    free = w - F.try_divide(w2, w)
    return F.when(free > 1e-12, F.sqrt(F.try_divide(F.when(left > 1e-12 * second, left).otherwise(0.0), free)))
