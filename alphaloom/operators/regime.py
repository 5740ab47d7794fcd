"""Regimes: rule labels, probabilities, weights, triple barriers, meta labels, features and records of hidden Markov models (fitted in ``chain``)."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, daily_ic, full, last_rows, pct_rank, ts
from ..sources.catalog import get_text, put_text



def days():
    """All rows by date: for tables of one row per day."""
    return Window.orderBy("date")


def rule_regime(bench: DataFrame, trend: int = 60, vol: int = 20, limit: float = 0.022) -> DataFrame:
    """(date, regime) of a benchmark(date, close): bull, bear or chop (warm-up too). One row per day: one small window."""
    r = bench.select("date", "close", (F.try_divide(F.col("close"), F.lag("close").over(days())) - 1).alias("r"))
    frame = days().rowsBetween(-(vol - 1), 0)
    t = F.try_divide(F.col("close"), F.lag("close", trend).over(days())) - 1
    v = F.when(F.count("r").over(frame) >= vol, F.stddev_samp("r").over(frame))
    named = r.select("date", t.alias("t"), v.alias("v"))
    return named.select("date", F.when((F.col("t") > 0) & (F.col("v") < limit), "bull").when((F.col("t") < 0) & (F.col("v") >= limit), "bear").otherwise("chop").alias("regime"))


def attach(rows: DataFrame, regimes: DataFrame, default: str = "chop") -> DataFrame:
    return rows.join(F.broadcast(regimes), "date", "left").withColumn("regime", F.coalesce("regime", F.lit(default)))


def breakdown(rows: DataFrame, target: str = "ret", least: int = 5) -> DataFrame:
    """Mean daily IC of each formula in each regime; days under ``least`` rows or with a constant do not count."""
    there = rows.where(F.col("signal").isNotNull() & F.col(target).isNotNull())
    by = ["formula_id", "regime", "date"]
    ranked = there.select(*by, average_rank(F.col("signal"), *by).alias("a"), average_rank(F.col(target), *by).alias("b"))
    days = ranked.groupBy(*by).agg(F.when((F.count("*") >= least) & (F.min("a") < F.max("a")), daily_ic(F.col("a"), F.col("b"))).alias("ic"))
    return days.groupBy("formula_id", "regime").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("days"))


def cosine_to(probs: DataFrame, reference: list[float]) -> DataFrame:
    """``probs(date, p array)`` with the cosine to a reference vector, clipped to [0, 1]; 0 for a zero vector."""
    ref = F.array(*[F.lit(float(x)) for x in reference])
    norm = math.sqrt(sum(x * x for x in reference))
    dot = F.aggregate(F.zip_with("p", ref, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    own = F.sqrt(F.aggregate(F.transform("p", lambda v: v * v), F.lit(0.0), lambda a, v: a + v))
    return probs.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, own * norm), F.lit(0.0)))))


def regime_weights(probs: DataFrame, ref_date=None, low: float = 0.1, high: float = 1.0, temperature: float = 5.0) -> DataFrame:
    """(date, weight): exponential in the similarity to the probabilities of the latest date at or before ``ref_date``."""
    past = probs if ref_date is None else probs.where(F.col("date") <= F.lit(ref_date))
    ref = past.orderBy(F.desc("date")).select("p").first()
    return cosine_to(probs, list(ref[0])).select("date", (low + (high - low) * F.exp(temperature * (F.col("similarity") - 1))).alias("weight"))


def fold_similarity(probs: DataFrame, folds: list[tuple[int, list]]) -> dict[int, float]:
    """The mean similarity of each fold's days (``ic.folds``) to the latest day among ``probs(date, p array)``."""
    days = [d for _, ds in folds for d in ds]
    ref = probs.orderBy(F.desc("date")).select("p").first()
    if not days or ref is None:
        return {}
    table = probs.sparkSession.createDataFrame([(k, d) for k, ds in folds for d in ds], "fold int, date date")
    like = cosine_to(probs, list(ref[0])).join(F.broadcast(table), "date").groupBy("fold").agg(F.avg("similarity").alias("s"))
    return {r.fold: r.s for r in like.collect()}


def triple_barrier(panel: DataFrame, horizon: int = 5, up: float = 2.0, down: float = 2.0, vol_window: int = 20, floor: float = 0.005, long_only: bool = False) -> DataFrame:
    """``label`` (1 up first, -1 down first, 0 neither) and ``weight`` for each row whose ticker is long enough.

    Barriers are the close times 1 +- multiple x volatility; the next ``horizon`` closes of a row are one short
    array, in which the first touch is a position. The last ``horizon`` rows and the first ``vol_window`` rows
    are 0 with weight 0.
    """
    r = panel.select("ticker", "date", "pclose", (F.try_divide(F.col("pclose"), F.lag("pclose").over(ts())) - 1).alias("r"))
    whole = Window.partitionBy("ticker")
    sigma = F.greatest(F.stddev_samp("r").over(last_rows(vol_window)), F.lit(floor))
    sigma = full(F.col("r"), vol_window, sigma)
    x = r.select("ticker", "date", "pclose", sigma.alias("sigma"), F.collect_list("pclose").over(ts().rowsBetween(1, horizon)).alias("ahead"), (F.row_number().over(ts()) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    x = x.where(F.col("n") >= vol_window + horizon + 5)
    x = x.withColumn("hi", F.col("pclose") * (1 + up * F.col("sigma"))).withColumn("lo", F.col("pclose") * (1 - down * F.col("sigma")))
    first_hi = F.array_position(F.transform("ahead", lambda v: v >= F.col("hi")), True)
    first_lo = F.array_position(F.transform("ahead", lambda v: v <= F.col("lo")), True)
    x = x.withColumn("a", first_hi).withColumn("b", first_lo)
    live = (F.col("i") >= vol_window) & (F.col("i") < F.col("n") - horizon) & F.col("sigma").isNotNull()
    hit = F.when((F.col("a") > 0) & ((F.col("b") == 0) | (F.col("a") <= F.col("b"))), 1.0).when(F.col("b") > 0, 0.0 if long_only else -1.0).otherwise(0.0)
    return x.select("ticker", "date", F.when(live, hit).otherwise(0.0).alias("label"), F.when(live, 1.0).otherwise(0.0).alias("weight"))


def label_shares(labels: DataFrame) -> DataFrame:
    total = labels.agg(F.count("*").alias("total"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def meta_dataset(rows: DataFrame) -> DataFrame:
    """Features of a secondary model: signal rank, factor ranks, regime flags, recent RankIC; and the label.

    ``rows``: ticker, date, signal, ret, tb_label, regime and the factor ranks. The recent IC is the mean of
    the last 20 days' Spearman correlation (5 at least), the day's own included.
    """
    by = ["date"]
    there = rows.where("signal is not null and ret is not null").select("date", average_rank(F.col("signal"), *by).alias("a"), average_rank(F.col("ret"), *by).alias("b"))
    per_day = there.groupBy("date").agg(daily_ic(F.col("a"), F.col("b")).alias("ic"))
    frame = days().rowsBetween(-19, 0)
    recent = per_day.select("date", F.when(F.count("ic").over(frame) >= 5, F.avg("ic").over(frame)).alias("recent_ic"))
    label = F.when(F.coalesce(F.col("tb_label") > 0, F.lit(False)) | (F.col("tb_label").isNull() & F.coalesce(F.col("ret") >= 0, F.lit(False))), 1).otherwise(0)
    flags = [F.when(F.col("regime") == k, 1).otherwise(0).alias(f"is_{k}") for k in ("bull", "chop", "bear")]
    return rows.join(F.broadcast(recent), "date", "left").select("ticker", "date", pct_rank(F.col("signal"), "date").alias("sig_rank"), "size_rank", "vol_rank", "mom_rank", "recent_ic", *flags, label.alias("label"))


META_FEATURES = ["sig_rank", "size_rank", "vol_rank", "mom_rank", "recent_ic", "is_bull", "is_chop", "is_bear"]


def train_meta(data: DataFrame, train_end, c: float = 1.0):
    """A balanced logistic model on standardized features before ``train_end``; (model, auc on the rest), or (None, reason)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    data = data.na.drop(subset=META_FEATURES)
    train = data.where(F.col("date") < F.lit(train_end))
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total < 20 or len(counts) < 2:
        return None, f"{total} rows of {len(counts)} classes"
    weight = F.when(F.col("label") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    steps = [
        VectorAssembler(inputCols=META_FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(weightCol="w", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False),
    ]
    model = Pipeline(stages=steps).fit(train.withColumn("w", weight))
    rest = data.where(F.col("date") >= F.lit(train_end))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(rest)) if rest.limit(10).count() == 10 else None
    return model, auc


def predict_meta(model, data: DataFrame) -> DataFrame:
    """``p`` for each row; 0.5 where features are missing."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return data.withColumn("p", F.lit(0.5))
    scored = model.transform(data.na.drop(subset=META_FEATURES)).select("ticker", "date", vector_to_array("probability")[1].alias("p"))
    return data.join(scored, ["ticker", "date"], "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


def filter_signal(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The signal where the secondary model's chance reaches the threshold, else null."""
    return rows.withColumn("signal", F.when(F.col("p") >= threshold, F.col("signal")))


def hmm_features(bars: DataFrame) -> DataFrame:
    """Log return, 14-row true range over close, volume over its 20-row mean, high-low over close; complete rows only."""
    c, h, l, v = (F.col(x) for x in ("pclose", "phigh", "plow", "vlot"))
    prev = F.lag("pclose").over(ts())
    x = bars.select("ticker", "date", F.ln(F.try_divide(c, prev)).alias("log_ret"), F.when(prev.isNull(), h - l).otherwise(F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))).alias("tr"), "pclose", "vlot", F.try_divide(h - l, c).alias("hl"))
    out = x.select("ticker", "date", "log_ret", full(F.col("tr"), 14, F.avg("tr").over(last_rows(14)) / c).alias("atr"), full(v, 20, F.try_divide(v, F.avg("vlot").over(last_rows(20)))).alias("vol_ratio"), "hl")
    return out.na.drop()


def robust_scale(rows: DataFrame, names: list[str], train_end=None) -> DataFrame:
    """Each feature less its median over its interquartile range, both of the rows up to ``train_end`` (10 at least, else all)."""
    train = rows if train_end is None else rows.where(F.col("date") <= F.lit(train_end))
    if train_end is not None and train.limit(10).count() < 10:
        train = rows
    stats = train.agg(*[F.percentile(F.col(n), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in names]).first()
    return rows.select(*[c for c in rows.columns if c not in names], *[((F.col(n) - stats[n][1]) / ((stats[n][2] - stats[n][0]) or 1.0)).alias(n) for n in names])


def save_hmm(spark, model: dict, path: str, **about) -> None:
    """Parameters and what is known about them (dates, features) as JSON."""
    put_text(spark, json.dumps({"model": model, "about": about}), path)


def load_hmm(spark, path: str) -> tuple[dict, dict]:
    found = get_text(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    whole = json.loads(found)
    return whole["model"], whole["about"]


def align_states(old: np.ndarray, new: np.ndarray) -> list[int]:
    """The order of new states (rows of means) that lies nearest to the old ones; few states, so all orders are tried."""
    k = len(old)
    if len(new) != k:
        return list(range(len(new)))
    cost = np.linalg.norm(old[:, None] - new[None], axis=2)
    return list(min(itertools.permutations(range(k)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p))))


def reorder(p: Column, order: list[int]) -> Column:
    return F.array(*[F.element_at(p, j + 1) for j in order])
