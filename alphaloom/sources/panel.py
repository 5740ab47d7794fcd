"""Panels: scans, derivation, deduplication, upserts, as-of joins, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel: one row per (ticker, date), typical price derived where it is missing."""
    raw = spark.read.parquet(path)
    panel = dedupe(raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns]), ["ticker", "date"], F.struct(*[F.col(c) for c in sorted(c.lower() for c in raw.columns)]))
    return with_typical(panel)


def with_typical(panel: DataFrame) -> DataFrame:
    """``ptyp`` and ``pvwap``: two names of the mean of high, low and close."""
    mean = (F.col("phigh") + F.col("plow") + F.col("pclose")) / 3
    return panel.withColumn("ptyp", mean).withColumn("pvwap", mean)


def dedupe(rows: DataFrame, keys: list[str], first_by: Column) -> DataFrame:
    """The first row of each key by a stated order; a key's rows are reduced before they are shuffled."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), first_by).alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def derive(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """A supplier panel from order lines: price = extended price / quantity, bucketed by ``unit``.

    Open and close are the first and last price by (ship date, order, line, price, quantity). That order is no plain number,
    so lines are sorted to be reduced: they are dealt first, as sorting what a task reads takes memory by the size of its
    split, and few of its lines share a ticker and date.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"), *order, "l_extendedprice", "l_quantity").repartition("ticker", "date")
    lines = dealt.select("ticker", "date", px.alias("px"), F.col("l_quantity").alias("q"), F.struct(*order, px.alias("px"), "l_quantity").alias("o"))
    panel = lines.groupBy("ticker", "date").agg(F.min_by("px", "o").alias("popen"), F.max("px").alias("phigh"), F.min("px").alias("plow"), F.max_by("px", "o").alias("pclose"), F.sum("q").alias("vlot"))
    return with_typical(panel)


def derive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily user panel from events: last value, extremes, sum and count of the day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "value", F.struct("ts", "event_id").alias("o"))
    panel = e.groupBy("ticker", "date").agg(F.min_by("value", "o").alias("popen"), F.max("value").alias("phigh"), F.min("value").alias("plow"), F.max_by("value", "o").alias("pclose"), F.count("*").cast("double").alias("vlot"))
    return with_typical(panel)


def next_return() -> Column:
    """The return from the next row to the one after it."""
    return F.try_divide(F.lead("pclose", 2).over(ts()), F.lead("pclose", 1).over(ts())) - 1


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old ones with their keys; of several new rows with one key, the greatest by their other columns."""
    others = [F.col(c) for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*keys, "__row.*") if others else new.distinct()
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def split_date(panel: DataFrame, share: float = 0.7):
    """The day that divides the panel's time span; a literal, so that filters on it reach the scan."""
    low, high = panel.agg(F.min("date"), F.max("date")).first()
    return low + (high - low) * share if low else None


def last_dates(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct dates; the dates are few and broadcast."""
    days = panel.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return panel.join(F.broadcast(days), "date", "left_semi")


def benchmark(panel: DataFrame) -> DataFrame:
    """Volume-weighted mean close of each date."""
    return panel.groupBy("date").agg((F.sum(F.col("pclose") * F.col("vlot")) / F.sum("vlot")).alias("close"))


def read_benchmark(spark: SparkSession, *paths: str) -> DataFrame:
    """(date, close) from the first of ``paths`` that is there (Parquet, or CSV with a header), by its first known price column."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            continue
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
        price = next((c for c in ("Close", "Pclose", "close", "CLOSE") if c in rows.columns), None)
        day = next((c for c in ("Date", "date") if c in rows.columns), None)
        if price and day:
            return rows.select(F.to_date(F.col(day)).alias("date"), F.col(price).cast("double").alias("close"))
    raise FileNotFoundError(f"no benchmark with a date and a price in {', '.join(paths)}")


def require_fresh(panel: DataFrame, today, days: int = 3) -> None:
    """An error where the panel's last date is more than ``days`` days before ``today`` (or there is none)."""
    last = panel.agg(F.max("date")).first()[0]
    if last is None or (today - last).days > days:
        raise RuntimeError(f"SAFE_MODE: the last date is {last}, today is {today}")


def returns_by_code(prices: DataFrame, codes: list[str]) -> DataFrame:
    """``prices(date, code, price)`` -> one row per date with ``<code>_RET``, each price over the code's one before.

    Returns are made in long form, a window per code; the columns of the named codes are only how they are shown.
    Of several prices on a date the greatest counts; a date without a price of a code has a null.
    """
    one = prices.groupBy("code", "date").agg(F.max("price").alias("price"))
    r = one.select("date", "code", (F.try_divide(F.col("price"), F.lag("price").over(Window.partitionBy("code").orderBy("date"))) - 1).alias("r"))
    return r.groupBy("date").agg(*[F.max(F.when(F.col("code") == c, F.col("r"))).alias(f"{c}_RET") for c in codes])


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right values at or before it: a union and one window, one shuffle by ``by``.

    A missing right value takes the one before it. Several right rows at one time: the greatest by values.
    """
    lcols = left.columns
    l = left.select(*[F.col(c) for c in lcols], F.col(left_on).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values])
    r = right.select(*[(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in lcols], F.col(right_on).alias("__at"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("__at", "__side", *[f"__{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    filled = l.unionByName(r).select("*", *[F.last(f"__{v}", ignorenulls=True).over(w).alias(v) for v in values])
    return filled.where("__side = 1").select(*lcols, *values)


def trading_calendar(panel: DataFrame) -> DataFrame:
    """(date, idx): the panel's dates numbered from 0; one row per day, so one task can number them."""
    return panel.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def exit_dates(entries: DataFrame, calendar: DataFrame, hold: int) -> DataFrame:
    """Entries with the day ``hold`` trading days after the first calendar day at or after their date (null beyond the end)."""
    cal = F.broadcast(calendar)
    days = entries.select("date").distinct()
    start = days.join(cal.select(F.col("date").alias("__d"), "idx"), F.col("__d") >= F.col("date")).groupBy("date").agg(F.min("idx").alias("__idx"))
    ends = start.join(cal.select(F.col("date").alias("exit_date"), "idx"), F.col("idx") == F.col("__idx") + hold, "left").select("date", "exit_date")
    return entries.join(F.broadcast(ends), "date", "left")


def chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(chunk_start, chunk_end): a span cut into pieces of ``days`` days."""
    s = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {int(days)} days)) chunk_start")
    return s.select("chunk_start", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")).alias("chunk_end"))


def fundamentals(wide: DataFrame, periods: list[str], lag_days: int = 45) -> DataFrame:
    """Wide ``YYYY/M`` columns to rows (ticker, item, value, date): known ``lag_days`` after the month's end."""
    rows = wide.unpivot(["ticker", "item"], periods, "period", "value")
    part = F.split("period", "/")
    end = F.last_day(F.make_date(part[0].cast("int"), part[1].cast("int"), F.lit(1)))
    return rows.select("ticker", "item", "value", F.date_add(end, lag_days).alias("date"))


def top_with_relaxation(rows: DataFrame, score: str, size: str, n: int, thresholds=(70, 50, 30, 0)) -> DataFrame:
    """The ``n`` largest by ``size`` among rows at or above the first threshold that any row reaches."""
    best = F.max(F.coalesce(*[F.when(F.col(score) >= t, F.lit(t)) for t in thresholds]))
    edge = rows.agg(best.alias("__edge"))
    return rows.crossJoin(F.broadcast(edge)).where(F.col(score) >= F.col("__edge")).drop("__edge").orderBy(F.desc(size), *[c for c in rows.columns if c != size]).limit(n)


def dense(panel: DataFrame, values: list[str]) -> DataFrame:
    """Every ticker on every date of the panel (union calendar), values carried forward inside a ticker."""
    grid = panel.select("ticker").distinct().crossJoin(F.broadcast(panel.select("date").distinct()))
    w = ts().rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(panel.select("ticker", "date", *values), ["ticker", "date"], "left")
    return joined.select("ticker", "date", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def master(prices: DataFrame, macro: DataFrame, funds: DataFrame, items: DataFrame) -> DataFrame:
    """``prices(ticker, date, pclose, ...)`` with macro series and fund returns of their date, fundamentals of their ticker and date, and two ratios.

    What is known is carried forward inside a ticker, never back. ``items(ticker, date, capital, equity, income)`` give
    ``pd_dd`` (market value over equity) and ``fk`` (over income, where that is positive) and are then left out.
    """
    j = prices.join(macro, "date", "left").join(funds, "date", "left").join(items, ["ticker", "date"], "left")
    w = ts().rowsBetween(Window.unboundedPreceding, 0)
    values = [c for c in j.columns if c not in ("ticker", "date")]
    filled = j.select("ticker", "date", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in values])
    market = F.col("pclose") * F.col("capital")
    ratios = {"pd_dd": F.try_divide(market, F.col("equity")), "fk": F.when(F.col("income") > 0, F.try_divide(market, F.col("income")))}
    return filled.withColumns(ratios).drop("capital", "equity", "income")
