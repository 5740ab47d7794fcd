"""Daily information coefficients, factors, neutralisation, folds and walk-forward fitness."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, daily_ic, full, last_rows, ordinal_norm, safe_corr, ts
from ..functions.ranges import average_ranks
from ..sources.catalog import keep


def daily(rows: DataFrame, target: str = "ret", *keys: str) -> DataFrame:
    """IC and RankIC of each formula and date (and ``keys``): (formula_id, date, ic, rank_ic, n).

    Only rows with both values count; ranks are taken inside those rows. One shuffle for the ranks, whose
    partitioning (formula, date) the aggregation reuses.
    """
    by = ["formula_id", *keys, "date"]
    there = rows.where(F.col("signal").isNotNull() & F.col(target).isNotNull())
    ranked = there.select(*by, "signal", F.col(target).alias("y"), average_rank(F.col("signal"), *by).alias("rs"), average_rank(F.col(target), *by).alias("ry"))
    return ranked.groupBy(*by).agg(daily_ic(F.col("signal"), F.col("y")).alias("ic"), daily_ic(F.col("rs"), F.col("ry")).alias("rank_ic"), F.count("*").alias("n"))


SLICE, STACKED = 3, 1 << 16  # formulas that are stacked in one task; stacked rows that a task is meant to hold


def pool_tasks(dates: int, rows: int, formulas: int) -> int:
    """Tasks for ``pool_days``: of ``STACKED`` stacked rows, but no more than keep dates and slices apart."""
    return max(1, min(math.ceil(rows * formulas / STACKED), 4 * dates * math.ceil(formulas / SLICE)))


def pool_days(wide: DataFrame, ids: list[str], target: str = "ret", size: str = "size", tasks: int | None = None) -> DataFrame:
    """``daily`` of every formula of a pool, and ``c``, the rank correlation with ``size`` (``size_corr`` before its mean), from columns.

    ``wide`` has a column of signals for each formula, without nulls. Its rows are dealt by date and slice of the pool, one
    for ``SLICE`` formulas, which are stacked where they then stand: a task's rows do not grow with the pool. They are dealt
    to ``tasks`` (``pool_tasks``), as the bytes that are dealt say little of the rows stacked from them. One sort of a
    formula's day gives the ranks both among rows with a target and among rows with a size: places run from the ties' first
    row to their last.
    """
    width = math.ceil(len(ids) / math.ceil(len(ids) / SLICE))
    slices = F.posexplode(F.array(*[F.array(*ids[i : i + width]) for i in range(0, len(ids), width)])).alias("part", "xs")
    dealt = wide.select("date", F.col(target).alias("y"), F.col(size).alias("z"), slices)
    dealt = dealt.repartition(tasks, "part", "date") if tasks else dealt
    ranked = dealt.select("part", "date", "y", average_rank(F.col("y"), "part", "date").alias("ry"), "z", average_rank(F.col("z"), "part", "date").alias("rz"), "xs")
    rows = ranked.select("part", "date", "y", "ry", "z", "rz", F.posexplode("xs").alias("f", "x"))
    w = Window.partitionBy("part", "f", "date").orderBy("x")
    before, here = (w.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    ties = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("*", (F.row_number().over(w) == F.rank().over(w)).alias("first"), *[F.count(c).over(span).alias(f"{c}{k}") for c in ("y", "z") for k, span in enumerate((before, ties))])
    placed = placed.withColumn("start", F.last(F.when(F.col("first"), F.struct("y0", "z0")), ignorenulls=True).over(here))
    among = lambda c, value: F.when(F.col(c).isNotNull(), value)
    rank = lambda c: among(c, (F.col(f"start.{c}0") + 1 + F.col(f"{c}1")) / 2.0)
    both = placed.select("part", "f", "date", among("y", F.col("x")).alias("x"), "y", rank("y").alias("xy"), among("y", F.col("ry")).alias("ry"), "z", rank("z").alias("xz"), among("z", F.col("rz")).alias("rz"))
    sized = F.when((F.count("z") >= 5) & (F.min("xz") < F.max("xz")) & (F.min("rz") < F.max("rz")), safe_corr(F.col("xz"), F.col("rz")))
    days = both.groupBy("part", "f", "date").agg(daily_ic(F.col("x"), F.col("y")).alias("ic"), daily_ic(F.col("xy"), F.col("ry")).alias("rank_ic"), F.count("y").alias("n"), sized.alias("c"))
    return days.select(F.array(*map(F.lit, ids))[F.col("part") * width + F.col("f")].alias("formula_id"), "date", "ic", "rank_ic", "n", "c")


def summary(ics: DataFrame, *keys: str) -> DataFrame:
    return ics.groupBy("formula_id", *keys).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.stddev_samp("rank_ic").alias("rank_ic_std"), F.count("rank_ic").alias("days"))


def pooled_rank_ic(rows: DataFrame, target: str = "ret") -> DataFrame:
    """Spearman correlation of each formula over all rows, dates together; ranks by ranges of values, which travel with the rows."""
    there = rows.where(F.col("signal").isNotNull() & F.col(target).isNotNull()).select("formula_id", "ticker", "date", "signal", target)
    ranked = average_ranks(there, "formula_id", "signal", "rs", ["ticker", "date"], lambda df: keep(df, "ranks"))
    ranked = average_ranks(ranked, "formula_id", target, "ry", ["ticker", "date"], lambda df: keep(df, "ranks"))
    return ranked.groupBy("formula_id").agg(daily_ic(F.col("rs"), F.col("ry")).alias("rank_ic"), F.count("*").alias("n"))


def factors(panel: DataFrame) -> DataFrame:
    """``size`` (log price, times shares where known), ``vol`` (20-row deviation of returns, 5 at least), ``mom`` (20-row return)."""
    price = F.greatest(F.col("pclose"), F.lit(1e-6))
    size = F.ln(price * F.coalesce(F.col("shares_outstanding"), F.lit(1.0))) if "shares_outstanding" in panel.columns else F.ln(price)
    with_ret = panel.withColumn("__r", F.try_divide(F.col("pclose"), F.lag("pclose").over(ts())) - 1)
    r = F.col("__r")
    vol = full(r, 20, F.stddev_samp(r).over(last_rows(20)), least=5)
    return with_ret.select("*", size.alias("size"), vol.alias("vol"), (F.try_divide(F.col("pclose"), F.lag("pclose", 20).over(ts())) - 1).alias("mom")).drop("__r")


def factor_ranks(rows: DataFrame, names=("size", "vol", "mom")) -> DataFrame:
    return rows.select("*", *[ordinal_norm(F.col(n), "date").alias(f"{n}_rank") for n in names])


def size_corr(rows: DataFrame) -> DataFrame:
    """Mean over dates (5 rows at least, nothing constant) of the rank correlation of signal and size."""
    by = ["formula_id", "date"]
    there = rows.where("signal is not null and size is not null")
    ranked = there.select(*by, average_rank(F.col("signal"), *by).alias("a"), average_rank(F.col("size"), *by).alias("b"))
    days = ranked.groupBy(*by).agg(F.when((F.count("*") >= 5) & (F.min("a") < F.max("a")) & (F.min("b") < F.max("b")), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b"))).alias("c"))
    return days.groupBy("formula_id").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("size_corr"))


def residual_one(rows: DataFrame, y: str, x: str, out: str, least: int = 10) -> DataFrame:
    """Per formula and date: residual of y on x and a constant, from sums; under ``least`` rows y itself."""
    by = Window.partitionBy("formula_id", "date")
    a, b = F.when(F.col(x).isNotNull(), F.col(y)), F.when(F.col(y).isNotNull(), F.col(x))
    slope = F.coalesce(F.try_divide(F.covar_pop(a, b).over(by), F.nullif(F.var_pop(b).over(by), F.lit(0.0))), F.lit(0.0))
    res = a - F.avg(a).over(by) - slope * (b - F.avg(b).over(by))
    return rows.withColumn(out, F.when(F.count(a).over(by) >= least, res).otherwise(F.col(y)))


def neutralize(rows: DataFrame, factors: list[str], bins: int = 10, least: int = 10) -> DataFrame:
    """Two stages per formula and date: the signal's rank is regressed on factor ranks, then demeaned in size bins.

    ``rows``: formula_id, ticker, date, signal and ``factors`` (the first is the size rank). The residual of a
    regression is what is left after taking away the projections on the factors made orthogonal one after
    another; a factor that depends on those before adds nothing, so collinear factors are no error. All steps are
    window sums of one partitioning. Rows with a missing factor get a null; dates under ``least`` rows keep the
    raw signal, those with under ``least`` complete rows are demeaned only.
    """
    w = Window.partitionBy("formula_id", "date")
    names = [f"__f{k}" for k in range(len(factors))]
    signal = F.col("signal").cast("double")
    place = (F.row_number().over(w.orderBy(signal.asc_nulls_last(), "ticker")) - 1) / F.greatest(F.lit(1), F.count(signal).over(w) - 1) - 0.5
    fine = signal.isNotNull()
    for f in factors:
        fine = fine & F.col(f).isNotNull()
    df = rows.select("formula_id", "ticker", "date", signal.alias("signal"), F.col(factors[0]).alias("__size"), place.alias("__y"), fine.alias("__fine"), F.count("*").over(w).alias("__n"), *[F.col(f).alias(n) for f, n in zip(factors, names)])
    centred = [F.when(F.col("__fine"), F.col(c) - F.avg(F.when(F.col("__fine"), F.col(c))).over(w)).alias(c) for c in ("__y", *names)]
    df = df.select("formula_id", "ticker", "date", "signal", "__size", "__n", F.count_if("__fine").over(w).alias("__m"), *centred)
    for k, n in enumerate(names):
        square = F.sum(F.col(n) * F.col(n)).over(w)
        less = lambda c: F.col(c) - F.coalesce(F.when(square > 1e-12, F.sum(F.col(c) * F.col(n)).over(w) / square), F.lit(0.0)) * F.col(n)  # noqa: B023, E731
        df = df.withColumns({c: less(c) for c in ("__y", *names[k + 1 :])})
    df = df.withColumn("__res", F.when(F.col("__m") >= least, F.col("__y")).otherwise(F.col("signal")))
    there = F.col("__res").isNotNull() & F.col("__size").isNotNull()
    df = df.withColumns({"__i": F.row_number().over(w.orderBy(F.when(there, F.col("__size")).asc_nulls_last(), "ticker")) - 1, "__there": F.count_if(there).over(w)})
    df = df.withColumn("__bin", F.when(there, size_bin(F.col("__i"), F.col("__there"), bins)))
    b = Window.partitionBy("formula_id", "date", "__bin")
    demeaned = F.when(there & (F.col("__there") >= 2) & (F.count("*").over(b) >= 2), F.col("__res") - F.avg("__res").over(b)).otherwise(F.col("__res"))
    return df.select("formula_id", "ticker", "date", F.when(F.col("__n") < least, F.col("signal")).otherwise(demeaned).alias("neutral"))


def size_bin(i: Column, n: Column, bins: int = 10) -> Column:
    """Quantile bin of ordinal i (from 0) among n."""
    q = F.least(F.lit(bins), F.greatest(F.lit(2), F.floor(n / 5)))
    return F.greatest(F.ceil(i * q / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0))


def demean_by_size(rows: DataFrame, value: str = "signal", size: str = "size") -> DataFrame:
    """``demeaned``: value less its size bin's mean, per formula and date; bins of one row are left."""
    day = ["formula_id", "date"]
    w = Window.partitionBy(*day)
    placed = rows.where(F.col(value).isNotNull() & F.col(size).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(size, "ticker")) - 1).withColumn("__n", F.count("*").over(w))
    placed = placed.withColumn("bin", size_bin(F.col("__i"), F.col("__n")))
    b = Window.partitionBy(*day, "bin")
    return placed.withColumn("demeaned", F.when(F.count("*").over(b) >= 2, F.col(value) - F.avg(value).over(b)).otherwise(F.col(value))).drop("__i", "__n")


def folds(dates: list[dt.date], n: int = 5, embargo: int = 3, least: int = 60) -> list[tuple[int, list[dt.date]]]:
    """Consecutive test folds of sorted distinct dates, ``embargo`` days cut at both ends of each; short folds are left out."""
    total = len(dates)
    if total < n * least:
        n = max(2, total // max(1, least))
    edges = np.linspace(0, total, n + 1).astype(int)
    out = []
    for k in range(n):
        a, b = edges[k] + embargo, edges[k + 1] - embargo
        if b - a >= least:
            out.append((k, dates[a:b]))
    return out


def purged_folds(dates: list[dt.date], n: int = 5, purge: int = 10, embargo: int = 5, least: int = 20) -> list[dict]:
    """The same test folds with their training dates: those ``purge`` business days before the test and earlier, and those after it."""
    out = []
    for k, test in folds(dates, n, embargo, least):
        limit = np.busday_offset(np.datetime64(test[0]), -purge, roll="backward").astype(object)
        out.append({"fold": k, "test": test, "train": [d for d in dates if d <= limit or d > test[-1]]})
    return out


def fold_table(spark, found: list[tuple[int, list[dt.date]]]) -> DataFrame:
    """(fold, date): small, to be broadcast."""
    return spark.createDataFrame([(k, d) for k, ds in found for d in ds], "fold int, date date")


def fold_ics(ics: DataFrame, fold_dates: DataFrame, least_rows: int = 20, weights: DataFrame | None = None) -> DataFrame:
    """Mean daily RankIC of each formula and fold; with ``weights(date, weight)`` the weighted mean over dates that have one."""
    rows = ics.join(F.broadcast(fold_dates), "date")
    if weights is None:
        return rows.groupBy("formula_id", "fold").agg(F.avg("rank_ic").alias("ric"), F.sum("n").alias("rows")).where(F.col("rows") >= least_rows)
    rows = rows.join(F.broadcast(weights), "date").where("rank_ic is not null")
    return rows.groupBy("formula_id", "fold").agg(F.try_divide(F.sum(F.col("weight") * F.col("rank_ic")), F.sum("weight")).alias("ric"), F.sum("n").alias("rows")).where(F.col("rows") >= least_rows)


def fitness(fold_rics: DataFrame, complexity: DataFrame, size: DataFrame, lambda_std: float = 0.5, lambda_cx: float = 0.001, lambda_size: float = 0.5, hard_limit: float = 0.95, min_folds: int = 2, neutral: bool = False) -> DataFrame:
    """Walk-forward fitness of each formula: mean fold RankIC less its spread, complexity and size penalties.

    A size correlation over ``hard_limit`` is status ``size_factor``, too few folds ``insufficient``, both -1e9.
    """
    per = fold_rics.where("ric is not null").groupBy("formula_id").agg(F.avg("ric").alias("mean_ric"), F.stddev_pop("ric").alias("std_ric"), F.count_if(F.col("ric") > 0).alias("pos_folds"), F.count("*").alias("n_folds"))
    rows = complexity.join(size, "formula_id", "left").join(per, "formula_id", "left")
    c = F.abs(F.coalesce("size_corr", F.lit(0.0)))
    penalty = F.lit(0.2 * lambda_size) * F.greatest(F.lit(0.0), c - 0.15) if neutral else F.lit(lambda_size) * F.greatest(F.lit(0.0), c - 0.3)
    status = F.when(c > hard_limit, "size_factor").when(F.coalesce("n_folds", F.lit(0)) < min_folds, "insufficient").otherwise("ok")
    value = F.col("mean_ric") - lambda_std * F.col("std_ric") - lambda_cx * F.col("complexity") - penalty
    return rows.withColumn("status", status).withColumn("fitness", F.when(F.col("status") == "ok", value).otherwise(F.lit(-1e9))).withColumn("verdict", verdict())


def verdict() -> Column:
    """A word for a walk-forward result; the order of the cases matters."""
    share = F.try_divide(F.col("pos_folds").cast("double"), F.col("n_folds").cast("double"))
    return (
        F.when(F.col("status") == "size_factor", "Size-Factor")
        .when(F.col("mean_ric").isNull() | (F.coalesce("n_folds", F.lit(0)) == 0), "—")
        .when((share >= 0.8) & (F.col("mean_ric") >= 0.005), "Stable")
        .when((share >= 0.6) & (F.col("mean_ric") > 0), "Unstable")
        .when((F.col("mean_ric") <= 0) | (share < 0.4), "Invalid")
        .otherwise("Overfit")
    )
