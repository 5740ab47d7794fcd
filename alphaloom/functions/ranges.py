"""Running totals and ranks over a whole table in one order, without a sort in one task.

Rows are dealt by range of the order; each range then adds the total of the ranges before it. Only one total for
each range meets in one place, and their number is that of the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__range"


def by_range(df: DataFrame, order: list[Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the number of each row's range in ``__range``, written by ``keep`` so that the ranges stay as they are."""
    return keep(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def offsets(parts: DataFrame, value: Column) -> DataFrame:
    """``(__range, __before)``: the sum of ``value`` over all ranges before; one row for each range."""
    totals = parts.groupBy(PART).agg(F.sum(value).alias("__total"))
    return totals.select(PART, (F.sum("__total").over(Window.orderBy(PART)) - F.col("__total")).alias("__before"))


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before this one in ``order``.

    ``order`` should tell rows apart; rows that tie in it stand in one range and get their totals in any order.
    An empty table stays empty.
    """
    parts = by_range(df, order, keep)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(offsets(parts, value)), PART).withColumn(name, F.col("__before") + inside).drop(PART, "__before")


def average_ranks(df: DataFrame, group: str, value: str, name: str, spread: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``: the rank of ``value`` among all rows of its ``group``, the mean rank for ties; ``value`` may not be null.

    Rows are dealt by range of (group, value, a hash of ``spread``), so rows that tie in a frequent value are split over
    ranges as well. Ranks are local ones plus the group's rows in the ranges before, less those that tie with the row; a
    tie can only cross a range's edge at its least or greatest value, so two counts for each range and group
    are all that is exchanged. Nothing is joined by value.
    """
    src = df.withColumn(value, F.col(value) + F.lit(0.0))
    parts = by_range(src, [F.col(group), F.col(value), F.xxhash64(*spread)], keep)
    each = parts.groupBy(PART, group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    ends = parts.join(each.select(PART, group, "low", "high"), [PART, group]).groupBy(PART, group).agg(F.count_if(F.col(value) == F.col("low")).alias("n_low"), F.count_if(F.col(value) == F.col("high")).alias("n_high"))
    each = keep(each.join(ends, [PART, group]))
    # one row for each range, group and edge value; as many as ranges and groups, twice
    edge = each.select(PART, group, F.explode(F.array_distinct(F.array(F.struct(F.col("low").alias("v"), F.col("n_low").alias("c")), F.struct(F.col("high").alias("v"), F.col("n_high").alias("c"))))).alias("e")).select(PART, group, "e.v", "e.c")
    tied = edge.select(PART, group, "v", F.sum("c").over(Window.partitionBy(group, "v")).alias("__all"), F.coalesce(F.sum("c").over(Window.partitionBy(group, "v").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__tied"))
    before = each.select(PART, group, F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = before.join(tied.groupBy(PART, group).agg(F.map_from_entries(F.collect_list(F.struct("v", F.struct("__all", "__tied")))).alias("__edges")), [PART, group])
    local = parts.withColumns({"__rank": F.rank().over(Window.partitionBy(PART, group).orderBy(value)), "__ties": F.count(F.lit(1)).over(Window.partitionBy(PART, group, value))}).join(at, [PART, group])
    edges = F.try_element_at("__edges", F.col(value))
    less = F.col("__before") - F.coalesce(edges["__tied"], F.lit(0)) + F.col("__rank") - 1
    ranked = local.withColumn(name, less + (F.coalesce(edges["__all"], F.col("__ties")) + 1) / 2.0)
    return ranked.drop(PART, "__rank", "__ties", "__before", "__edges")
