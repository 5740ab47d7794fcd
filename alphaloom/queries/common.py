"""Shared pieces of the queries and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, px, q"


def panel_sql(unit: str = "month") -> str:
    return f"""lines AS (SELECT l_suppkey AS ticker, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS q, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
panel0 AS (SELECT ticker, date, first(px {_ORDER}) AS popen, max(px) AS phigh, min(px) AS plow, last(px {_ORDER}) AS pclose, sum(q) AS vlot FROM lines GROUP BY ticker, date),
panel AS (SELECT *, (phigh + plow + pclose) / 3 AS ptyp FROM panel0)"""


MONTHLY = panel_sql("month")
WEEKLY = panel_sql("week")
TS = "PARTITION BY ticker ORDER BY date"
#: forward return and a signal: the close against its row before, ranked in the cross-section
RET = f"rets AS (SELECT *, lead(pclose, 2) OVER ({TS}) / lead(pclose, 1) OVER ({TS}) - 1 AS ret, pclose - lag(pclose, 5) OVER ({TS}) AS d5, ln(pclose) AS lx, ln(vlot) AS lv FROM panel)"


def frame(w: int) -> str:
    return f"OVER ({TS} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.derive(spark, sf_dir, "month")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.derive(spark, sf_dir, "week")


def with_ret(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", P.next_return())


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})
