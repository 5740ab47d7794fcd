"""Overfitting statistics: deflated Sharpe ratios, cross-validated backtest overfitting, ensembles, rolling checks."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import pct_rank, safe_corr

EULER = 0.5772156649015329


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, absolute error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - half).otherwise(half)


def best_of_noise(trials: int) -> float:
    """Expected best Sharpe ratio of ``trials`` formulas that are noise, times the root of the days observed."""
    if trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e))


def expected_max_sharpe(trials: int, days: int) -> float:
    """Expected best Sharpe ratio of ``trials`` formulas that are noise, over ``days`` observations (0 under two)."""
    return best_of_noise(trials) / math.sqrt(days) if days >= 2 else 0.0


def sharpe_inputs(returns: DataFrame, keys: tuple[str, ...] = ("formula_id",)) -> DataFrame:
    """Annualised Sharpe ratio, population skewness and excess kurtosis, days; five returns at least."""
    a = returns.groupBy(*keys).agg(F.count("ret").alias("days"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"))
    some = F.col("days") >= 5
    return a.select(*keys, "days", F.when(some, F.try_divide(F.col("m"), F.col("s")) * math.sqrt(252)).alias("sharpe"), F.when(some, F.col("skew")).alias("skew"), F.when(some, F.col("kurt")).alias("kurt"))


def deflated_sharpe(inputs: DataFrame, trials: int) -> DataFrame:
    """``z`` and ``p`` of each formula against the best of ``trials`` noise formulas."""
    null = F.when(F.col("days") >= 2, best_of_noise(trials) / F.sqrt("days")).otherwise(0.0)
    sr, n = F.col("sharpe"), F.greatest(F.col("days"), F.lit(1))
    var = F.greatest((1 - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr) / n, 1.0 / n)
    out = inputs.withColumn("null_sharpe", null).withColumn("z", (sr - F.col("null_sharpe")) / F.sqrt(var))
    return out.withColumn("p", normal_cdf(F.col("z"))).withColumn("significant", F.coalesce(F.col("p") >= 0.95, F.lit(False)))


def simple_deflated_sharpe(inputs: DataFrame, trials: int = 362) -> DataFrame:
    """The simpler form: the null from sqrt(2 ln N), half the squared ratio in the variance, 252 days at least."""
    root = math.sqrt(2 * math.log(trials)) if trials > 1 else 1.0
    null = (1 - EULER) * root + EULER / root if trials > 1 else 0.0
    sr, n = F.col("sharpe"), F.greatest(F.col("days"), F.lit(252))
    inner = (1 + 0.5 * sr * sr - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr) / n
    sigma = F.sqrt(F.when(inner > 0, inner))
    z = (sr - null) / (sigma + 1e-10)
    return inputs.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("p", normal_cdf(F.col("z")))


def pnl_slices(returns: DataFrame, slices: int = 8) -> DataFrame:
    """(formula_id, slice, pnl): mean return in ``slices`` even parts of each formula's days."""
    w = Window.partitionBy("formula_id")
    i = F.row_number().over(w.orderBy("date")) - 1
    n = F.count("*").over(w)
    edge = [F.floor(n * k / slices) for k in range(1, slices)]
    part = sum((F.when(F.col("i") >= e, 1).otherwise(0) for e in edge), F.lit(0))
    return returns.withColumn("i", i).withColumn("slice", part).groupBy("formula_id", "slice").agg(F.avg("ret").alias("pnl"))


def unranked(slices: int, take: int, rank: Column) -> Column:
    """The ``rank``-th way to take ``take`` of ``slices``, in lexicographic order, as an array of booleans.

    The number of ways that take a slice is a binomial; a rank below it takes the slice, any other leaves it and goes on
    by what is left over.
    """
    width = take + 1
    ways = F.array(*[F.lit(math.comb(n, k)) for n in range(slices) for k in range(width)]).cast("array<bigint>")
    of = lambda n, k: F.when(k > 0, F.get(ways, n * width + k - 1)).otherwise(F.lit(0))
    begin = F.struct(rank.cast("bigint").alias("r"), F.lit(take).alias("k"), F.array().cast("array<boolean>").alias("in"))

    def step(state: Column, s: Column) -> Column:
        w = of(F.lit(slices - 1) - s, state["k"])
        taken = state["r"] < w
        return F.struct(F.when(taken, state["r"]).otherwise(state["r"] - w).alias("r"), F.when(taken, state["k"] - 1).otherwise(state["k"]).alias("k"), F.concat(state["in"], F.array(taken)).alias("in"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(slices - 1)), begin, step, lambda state: state["in"])


def splits(spark: SparkSession, slices: int, most: int = 1000, seed: int = 42) -> DataFrame:
    """(combo, slice, inside): the ways to take half of the slices, a seeded sample of ``most`` where there are more.

    Ways are numbered in lexicographic order and made from their numbers on the executors; nothing is listed. A
    sample takes one number from each of ``most`` even parts of the range, by a hash of the seed and the part. At most
    60 slices: the numbers are of 64 bits.
    """
    if not 2 <= slices <= 60:
        raise ValueError("2 to 60 slices")
    total = math.comb(slices, slices // 2)
    n = min(total, most)
    width, extra = divmod(total, n)
    i = F.col("id")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i).cast("binary")), 1, 15), 16, 10).cast("bigint")
    rank = i * width + F.least(i, F.lit(extra)) + F.pmod(h, F.lit(width) + F.when(i < extra, 1).otherwise(0))
    rows = spark.range(n).select(i.cast("int").alias("combo"), unranked(slices, slices // 2, rank).alias("in"))
    return rows.select("combo", F.posexplode("in").alias("slice", "inside"))


def pbo_combos(sliced: DataFrame, combos: DataFrame) -> DataFrame:
    """Per combination: the best formula inside, its mean outside and the share of formulas better there.

    Means of all formulas are one aggregation; the ranks need only the best formula's value and a count, so no
    combination's formulas are gathered.
    """
    m = sliced.join(F.broadcast(combos), "slice").groupBy("combo", "formula_id").agg(F.avg(F.when(F.col("inside"), F.col("pnl"))).alias("is_mean"), F.avg(F.when(~F.col("inside"), F.col("pnl"))).alias("oos_mean"))
    best = m.groupBy("combo").agg(F.max_by(F.struct("formula_id", "is_mean", "oos_mean"), F.struct("is_mean", F.col("formula_id"))).alias("b"), F.count("*").alias("s"))
    j = m.join(best, "combo").groupBy("combo").agg(F.first("b.formula_id").alias("best"), F.first("b.is_mean").alias("is_mean"), F.first("b.oos_mean").alias("oos_mean"), F.count_if(F.col("oos_mean") > F.col("b.oos_mean")).alias("better"), F.first("s").alias("s"))
    omega = F.col("better") / F.greatest(F.col("s") - 1, F.lit(1))
    return j.select("combo", "best", "is_mean", "oos_mean", omega.alias("omega"), F.ln(F.greatest(omega, F.lit(1e-7)) / F.greatest(1 - omega, F.lit(1e-7))).alias("logit"))


def pbo(found: DataFrame) -> DataFrame:
    """Probability of backtest overfitting and its verdict."""
    a = found.agg(F.avg(F.when(F.col("logit") > 0, 1.0).otherwise(0.0)).alias("pbo"), F.avg("is_mean").alias("is_mean"), F.avg("oos_mean").alias("oos_mean"), F.count("*").alias("n_combinations"))
    degradation = F.try_divide(F.col("is_mean") - F.col("oos_mean"), F.abs("is_mean"))
    word = F.when(F.col("pbo").isNull(), "unknown").when(F.col("pbo") < 0.5, "low").when(F.col("pbo") < 0.7, "medium").otherwise("high")
    return a.select("pbo", "n_combinations", "is_mean", "oos_mean", degradation.alias("degradation"), word.alias("verdict"))


def single_pbo(sliced: DataFrame, combos: DataFrame) -> DataFrame:
    """Per formula: the share of combinations that gain inside and do not outside."""
    m = sliced.join(F.broadcast(combos), "slice").groupBy("combo", "formula_id").agg(F.avg(F.when(F.col("inside"), F.col("pnl"))).alias("a"), F.avg(F.when(~F.col("inside"), F.col("pnl"))).alias("b"))
    return m.groupBy("formula_id").agg(F.avg(F.when((F.col("a") > 0) & (F.col("b") <= 0), 1.0).otherwise(0.0)).alias("pbo"))


def combine(rows: DataFrame, weights: dict[str, float] | None = None, how: str = "rank") -> DataFrame:
    """(ticker, date, signal): pool members mixed where all of them are there; by percent rank per date or plainly."""
    ids = [r[0] for r in rows.select("formula_id").distinct().collect()] if weights is None else list(weights)
    w = weights or {k: 1.0 for k in ids}
    total = sum(w.values())
    value = pct_rank(F.col("signal"), "formula_id", "date") if how == "rank" else F.coalesce(F.col("signal"), F.lit(0.0))
    v = rows.where(F.col("formula_id").isin(ids)).select("formula_id", "ticker", "date", value.alias("v"))
    weight = F.coalesce(*[F.when(F.col("formula_id") == k, F.lit(x / total)) for k, x in w.items()])
    return v.groupBy("ticker", "date").agg(F.sum(weight * F.col("v")).alias("signal"), F.count("*").alias("n")).where(F.col("n") == len(ids)).drop("n")


def correlations(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(a, b, corr) of each two signal columns: one aggregation with all pairs' sums."""
    pairs = list(combinations(ids, 2))
    row = wide.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def greedy_pool(wide: DataFrame, ids: list[str], limit: float = 0.7) -> list[str]:
    """Members in order, each kept if its correlation to every one kept before is under the limit in size."""
    c = {(r.a, r.b): abs(r["corr"] or 0.0) for r in correlations(wide, ids).collect()}
    kept: list[str] = []
    for k in ids:
        if all(c[(j, k)] < limit for j in kept):
            kept.append(k)
    return kept


def overfit_table(train: DataFrame, test: DataFrame, top: int = 20, worst: float = -0.5) -> DataFrame:
    """RankIC of each formula on both parts (evaluated apart), degradation and whether it passes."""
    j = train.select("formula_id", F.col("rank_ic").alias("train_ric")).join(test.select("formula_id", F.col("rank_ic").alias("test_ric")), "formula_id")
    d = F.try_divide(F.col("test_ric") - F.col("train_ric"), F.abs("train_ric"))
    return j.select("*", d.alias("degradation"), F.coalesce(d > worst, F.lit(False)).alias("passed")).orderBy(F.desc("train_ric"), "formula_id").limit(top)


def windows(panel: DataFrame, months: int = 6, step: int = 3, start_share: float = 0.5) -> DataFrame:
    """(window_id, start, end): month-stepped test windows after a share of the span; a handful, broadcast."""
    low, high = panel.agg(F.min("date"), F.max("date")).first()
    if low is None:
        return panel.sparkSession.createDataFrame([], "window_id int, start date, end date")
    first = low + (high - low) * start_share
    s = panel.sparkSession.range(0, (high - first).days // (28 * step) + 2).select(F.col("id").cast("int").alias("window_id"), F.add_months(F.lit(first), (F.col("id") * step).cast("int")).alias("start"))
    return s.select("window_id", "start", F.add_months("start", months).alias("end")).where(F.col("start") < F.lit(high))


def in_windows(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows copied into each window they are in, under the key (window_id, ticker), so that warm-up restarts there."""
    j = panel.join(F.broadcast(spans), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("end"))).drop("start", "end")
    return j.withColumn("ticker", F.struct("window_id", "ticker"))
