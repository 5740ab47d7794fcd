"""Paper trades filled by a stream of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decay import on_disk


def fills(entries: DataFrame, prices: DataFrame, span: str = "100 days", delay: str = "31 days", limit: float = 0.5) -> DataFrame:
    """Entries with the price of their exit day, both as streams; append mode.

    ``entries``: ticker, date, exit_day, entry_px, slippage_bps and more; ``prices``: ticker, date, day, pclose, where
    ``day`` numbers the trading days and ``date`` is a timestamp. An interval join: a price meets entries of its ticker
    and day that are at most ``span`` old. Both sides wait ``delay`` for rows out of order, so what the join holds is
    bounded by ``span`` and ``delay``, not by the length of the stream. An entry is put out when its price comes, or without one when
    none can come any more; jumps beyond ``limit`` count as no price. Prices later than that are for ``operators.simulate.realized_pnl``.
    """
    e = on_disk(entries).withWatermark("date", delay).alias("e")
    p = prices.select(F.col("ticker").alias("p_ticker"), F.col("date").alias("p_date"), "day", F.col("pclose").alias("exit_px")).withWatermark("p_date", delay)
    j = e.join(p, F.expr(f"ticker = p_ticker and exit_day = day and p_date > date and p_date <= date + interval {span}"), "leftOuter")
    g = F.try_divide(F.col("exit_px"), F.col("entry_px")) - 1
    gross = F.when(F.abs(g) <= limit, g)
    return j.select(*[F.col(f"e.{c}") for c in entries.columns], "exit_px", gross.alias("gross_pnl_pct"), (gross - F.col("slippage_bps") / 1e4).alias("net_pnl_pct"))


def heartbeat(df: DataFrame, at: str, date: str = "date") -> DataFrame:
    """One row with ``df``'s columns that moves a stream's watermark when nothing else does: -1 and empty names, which meet nothing.

    Nulls would not do: a join's filters on its keys go below the watermark, and such a row would never reach it.
    """
    spark = df.sparkSession
    value = lambda f: F.lit(at) if f.name == date else F.lit("-1" if f.dataType.typeName() != "string" else "")
    return spark.range(1).select(*[value(f).cast(f.dataType).alias(f.name) for f in df.schema.fields])
