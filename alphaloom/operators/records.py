"""Decision records and results over windows: forensics snapshots, refits, the hall of fame, full evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import signals
from ..plans.formula import Node
from ..sources.catalog import keep
from ..sources.panel import next_return
from . import ic, overfit, simulate


def snapshot(acted: DataFrame, signals_: DataFrame, probs: DataFrame, adv: DataFrame, vol: DataFrame, capital: float = 1e6, share: float = 0.05, gamma: float = 0.1) -> DataFrame:
    """A record for each active position: action, regime state as JSON, dominant champion, liquidity and expected slippage.

    ``signals_``: regime, ticker, date, signal; the dominant champion is the regime with the largest |signal| x
    probability (ties to the lower regime). Unknown ADV or volatility give the fallback slippage.
    """
    each = probs.select("date", F.posexplode("p").alias("regime", "prob"))
    mix = signals_.join(F.broadcast(each), ["date", "regime"]).withColumn("pull", F.abs("signal") * F.col("prob"))
    lead = mix.groupBy("date", "ticker").agg(F.max_by("regime", F.struct("pull", -F.col("regime"))).alias("champion_id"))
    state = F.to_json(F.map_from_entries(F.transform(F.col("p"), lambda v, i: F.struct(F.concat(F.lit("regime_"), i.cast("string")), F.round(v, 6)))))
    top = probs.select("date", state.alias("hmm_state"), (F.array_position("p", F.array_max("p")) - 1).alias("hmm_top_regime"), F.array_max("p").alias("hmm_top_p"))
    j = acted.where("target_weight > 0 or prev_weight > 0").join(lead, ["date", "ticker"], "left").join(F.broadcast(top), "date", "left").join(adv, ["date", "ticker"], "left").join(vol, ["date", "ticker"], "left")
    value = F.col("turnover") * capital
    ratio = F.try_divide(value, F.col("adv") * share)
    return j.withColumn("adv_limit_ratio", ratio).withColumn("expected_slip_bps", simulate.slippage_bps(F.lit(gamma), F.col("sigma"), value, F.col("adv")))


def find_records(records: DataFrame, start, end, ticker=None) -> DataFrame:
    """Records of a span, of one ticker if named."""
    out = records.where((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)))
    return out if ticker is None else out.where(F.col("ticker") == F.lit(ticker))


def chained_equity(returns: DataFrame) -> DataFrame:
    """Windows of a walk-forward joined into one curve per formula: (formula_id, window_id, date, ret) -> equity carried over.

    A date in several windows counts in the first of them.
    """
    one = returns.withColumn("n", F.row_number().over(Window.partitionBy("formula_id", "date").orderBy("window_id"))).where("n = 1").drop("n")
    return simulate.equity(one)


def refit(panel: DataFrame, pool: dict[str, str | Node], spans: DataFrame, k: int = 10, drop: int = 2, limit: float = 0.7) -> DataFrame:
    """Per window: signals and factors of its rows alone, formulas too close to size left out, simulated returns.

    Every step has the window in its keys, so windows are parallel parts of one job.
    """
    inside = overfit.in_windows(panel, spans)
    rows = signals(ic.factors(inside.withColumn("ret", next_return())), pool, "ret", "size", by=F.col("ticker.window_id")).withColumn("window_id", F.col("ticker.window_id"))
    keyed = rows.withColumn("formula_id", F.concat_ws("@", "formula_id", F.col("window_id").cast("string")))
    fine = ic.size_corr(keyed).where(F.abs("size_corr") <= limit).select("formula_id")
    kept = keyed.join(fine, "formula_id", "left_semi").withColumn("ticker", F.col("ticker.ticker"))
    out = simulate.topk_dropout(kept, k, drop, keys=("formula_id", "window_id"))
    return out.withColumn("formula_id", F.split("formula_id", "@")[0])


def full_evaluation(panel: DataFrame, pool: dict[str, str | Node], bench: DataFrame, k: int = 10, drop: int = 2) -> DataFrame:
    """One row per formula: IC, RankIC, portfolio measures and those against the benchmark."""
    rows = signals(panel.withColumn("ret", next_return()), pool, "ret")
    returns = keep(simulate.topk_dropout(rows, k, drop), "returns")
    return ic.summary(ic.daily(rows)).join(simulate.metrics(simulate.equity(returns)).drop("days"), "formula_id").join(simulate.against_benchmark(returns, bench).drop("days"), "formula_id")
