"""Portfolio simulation and its measures; slippage, capacity, sizing, blending, ledgers, decay, forensics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ROW, decayed_sum, ewm_mean, ewm_std, full, last_rows, numbered, ts


def topk_dropout(rows: DataFrame, k: int = 10, drop: int = 2, buy_cost: float = 0.0005, sell_cost: float = 0.0015, keys: tuple[str, ...] = ("formula_id",)) -> DataFrame:
    """Daily returns of a long-only portfolio: (keys, date, ret, n_held, n_bought, n_sold).

    ``rows``: keys, ticker, date, signal, ret, and optionally slip. On the first day with a signal the k best
    are bought; then every day the ``drop`` worst holdings go (a missing signal is worst; ties by ticker up)
    and as many of the best not held come in (ties by ticker down). A day without signals earns 0.

    Each day becomes one array, ordered by Spark; a formula's days then pass through a task one by one in order, with
    the k names held as all that is kept between them, so no task gathers a formula's rows.
    """
    slip = "slip" in rows.columns
    clean = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))  # noqa: E731  null for NaN
    one = F.struct(clean("signal").alias("signal"), "ticker", clean("ret").alias("ret"), (clean("slip") if slip else F.lit(None).cast("double")).alias("slip"))
    days = rows.groupBy(*keys, "date").agg(F.sort_array(F.collect_list(one), asc=False).alias("rows"))
    days = days.repartition(*keys).sortWithinPartitions(*keys, "date")
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            flat, ends = b.column(n_keys + 1).flatten(), b.column(n_keys + 1).value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            tickers = flat.field("ticker").to_pylist()
            signal, ret, slips = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("signal", "ret", "slip"))
            out, start = [], 0
            for key, end in zip(zip(*(b.column(i).to_pylist() for i in range(n_keys))), ends):
                if key != now:
                    now, held = key, []
                names, valid = tickers[start:end], int(np.count_nonzero(~np.isnan(signal[start:end])))
                held, row = _one_day(held, names, valid, signal[start:end], ret[start:end], slips[start:end] if slip else None)
                out.append(row)
                start = end
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 1], *columns], names=[*keys, "date", "ret", "n_held", "n_bought", "n_sold"])

    def _one_day(held: list, names: list, valid: int, signal, ret, slips) -> tuple[list, tuple]:
        if not valid:
            return held, (0.0, len(held), 0, 0)
        at = dict(zip(names, range(len(names))))
        if not held:
            new, gone = names[: min(k, valid)], []
            held = new
        else:
            place = lambda t: (signal[i] if (i := at.get(t, valid)) < valid else -np.inf, t)
            gone = sorted(held, key=place)[:drop]
            stay = [t for t in held if t not in gone]
            new = list(islice((t for t in names[:valid] if t not in stay), drop))
            held = stay + new
        size, here = max(1, len(held)), [at[t] for t in held if t in at]
        cost = len(new) / size * buy_cost + len(gone) / size * sell_cost
        if slips is not None:
            unit = slips[sorted(here)]
            unit = unit[np.isfinite(unit)]
            cost += (float(unit.mean()) if len(unit) else 0.0) * (len(new) + len(gone)) / size
        return held, (float(np.nansum(ret[here])) / size - cost, len(held), len(new), len(gone))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return days.mapInArrow(run, f"{kinds}, date date, ret double, n_held int, n_bought int, n_sold int")


def equity(returns: DataFrame, keys: tuple[str, ...] = ("formula_id",), start: float = 100_000.0) -> DataFrame:
    """Running equity and drawdown of daily returns."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", start * F.exp(F.sum(F.log1p("ret")).over(w)))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def metrics(curve: DataFrame, keys: tuple[str, ...] = ("formula_id",), start: float = 100_000.0) -> DataFrame:
    """Net return, information ratio (population deviation), worst drawdown and annualised return, percentages but for the ratio."""
    a = curve.groupBy(*keys).agg(F.count("*").alias("days"), F.max_by("equity", "date").alias("last"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.min("drawdown").alias("dd"))
    return a.select(*keys, "days", ((F.col("last") / start - 1) * 100).alias("net_return"), F.coalesce(F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("ir"), (F.col("dd") * 100).alias("mdd"), ((F.pow(F.col("last") / start, 252.0 / F.col("days")) - 1) * 100).alias("annual"))


def against_benchmark(returns: DataFrame, bench: DataFrame, keys: tuple[str, ...] = ("formula_id",)) -> DataFrame:
    """Excess return, alpha's information ratio and beta against a benchmark(date, close), joined by date.

    Beta is the sample covariance over the population variance.
    """
    w = Window.orderBy("date")
    b = bench.select("date", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)).alias("b"))
    j = returns.join(F.broadcast(b), "date").withColumn("x", F.col("ret") - F.col("b"))
    a = j.groupBy(*keys).agg(F.count("*").alias("days"), F.exp(F.sum(F.log1p("ret"))).alias("g"), F.exp(F.sum(F.log1p("b"))).alias("bg"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.covar_samp("ret", "b").alias("c"), F.var_pop("b").alias("v"))
    some = F.col("days") >= 10
    return a.select(*keys, "days", F.when(some, (F.col("g") - F.col("bg")) * 100).alias("excess"), F.when(some, F.coalesce(F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0)), F.lit(0.0))).alias("alpha_ir"), F.when(some, F.try_divide(F.col("c"), F.col("v"))).alias("beta"))


def scale_of(returns: DataFrame, target: float = 0.15, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """``returns(ticker, date, r)`` -> (ticker, date, scale): target volatility over the one known the row before.

    That is the larger of the 20-row deviation and the weighted one; where there is none, or it is 0, the scale is 1.
    """
    rolling = full(F.col("r"), 20, F.stddev_samp("r").over(last_rows(20)), least=5)
    v = numbered(returns.select("ticker", "date", "r")).select("ticker", "date", (F.greatest(rolling, ewm_std(F.col("r"), 5)) * F.sqrt(F.lit(252.0))).alias("v"))
    s = v.select("ticker", "date", F.when(F.col("v") > 0, F.greatest(F.lit(low), F.least(F.lit(high), target / F.col("v")))).otherwise(1.0).alias("s"))
    return s.select("ticker", "date", F.coalesce(F.lag("s").over(ts()), F.lit(1.0)).alias("scale"))


def vol_scale(panel: DataFrame, target: float = 0.15, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """The scale of each ticker and date from the returns of its closes."""
    return scale_of(panel.select("ticker", "date", (F.try_divide(F.col("pclose"), F.lag("pclose").over(ts())) - 1).alias("r")), target, low, high)


def vol_targeted(rows: DataFrame, target: float = 0.15, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """``rows`` for a simulation with each return times its ticker's scale (see ``scale_of``), made of those returns."""
    one = rows.groupBy("ticker", "date").agg(F.max("ret").alias("r"))  # a pool's formulas share their returns
    return rows.join(scale_of(one, target, low, high), ["ticker", "date"]).withColumn("ret", F.col("ret") * F.col("scale")).drop("scale")


def slippage_bps(gamma: Column, sigma: Column, value: Column, adv: Column, fallback: float = 10.0) -> Column:
    """Square-root impact in basis points; the fallback where an input is missing or not positive."""
    part = F.greatest(F.try_divide(value, adv), F.lit(1e-4))
    fine = sigma.isNotNull() & (adv > 0) & value.isNotNull()
    return F.when(fine, gamma * sigma * F.sqrt(part) * 1e4).otherwise(F.lit(fallback))


def unit_slippage(panel: DataFrame, gamma: float = 0.1, fallback: float = 10.0, mode: str = "reference") -> DataFrame:
    """(ticker, date, slip): gamma x volatility x sqrt(1 / ADV) x 1e4; mode "almgren" multiplies by the root of the close."""
    r = panel.withColumn("__r", F.try_divide(F.col("pclose"), F.lag("pclose").over(ts())) - 1)
    sigma = full(F.col("__r"), 20, F.stddev_samp("__r").over(last_rows(20)), least=5)
    x = r.select("ticker", "date", "pclose", sigma.alias("s")).join(adv(panel), ["ticker", "date"])
    unit = gamma * F.col("s") * F.sqrt(F.try_divide(F.lit(1.0), F.col("adv"))) * 1e4
    if mode == "almgren":
        unit = unit * F.sqrt("pclose")
    return x.select("ticker", "date", F.coalesce(unit, F.lit(fallback)).alias("slip"))


def adv(panel: DataFrame) -> DataFrame:
    """(ticker, date, adv): yesterday's lesser of the 20-row mean (5 at least) and the weighted mean (span 10, 3 at least) of traded value."""
    v = numbered(panel.select("ticker", "date", (F.col("vlot") * F.col("pclose")).alias("v")))
    x = F.col("v")
    weighted = F.when(F.count(x).over(ts().rowsBetween(Window.unboundedPreceding, 0)) >= 3, ewm_mean(x, 10))
    both = v.select("ticker", "date", F.least(full(x, 20, F.avg(x).over(last_rows(20)), least=5), weighted).alias("a"))
    return both.select("ticker", "date", F.lag("a").over(ts()).alias("adv"))


def capacity(holdings: DataFrame, share: float = 0.05, floor: float = 1e6, top: int = 20) -> DataFrame:
    """Smallest and median capacity of the tradable rows of holdings(formula_id, ticker, date, adv)."""
    active = F.count("*").over(Window.partitionBy("formula_id", "date"))
    c = holdings.where(F.col("adv") >= floor).withColumn("cap", F.col("adv") * share * F.least(active, F.lit(top)))
    return c.groupBy("formula_id").agg(F.min("cap").alias("capacity"), F.min_by("ticker", F.struct("cap", "ticker")).alias("bottleneck"), F.percentile("cap", F.lit(0.5)).alias("median_capacity"), F.count("*").alias("n"))


def calibrate_slippage(trades: DataFrame) -> DataFrame:
    """Least squares through the origin of y on x > 0, with R squared about the mean; under 5 rows null."""
    t = trades.where((F.col("x") > 0) & F.col("y").isNotNull())
    a = t.agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.avg("y").alias("my"))
    g = F.try_divide(F.col("xy"), F.col("xx"))
    rest = F.col("yy") - 2 * g * F.col("xy") + g * g * F.col("xx")
    return a.select("n", F.when(F.col("n") >= 5, g).alias("gamma"), F.when(F.col("n") >= 5, 1 - F.try_divide(rest, F.col("yy") - F.col("n") * F.col("my") * F.col("my"))).alias("r2"))


def blend_raw(signals: DataFrame, probs: DataFrame, top: int = 20, min_weight: float = 0.01) -> DataFrame:
    """(date, ticker, weight): champions' signals mixed by regime probability, the top names equally weighted and renormalised.

    ``signals``: regime, ticker, date, signal. Ties keep the lower ticker.
    """
    mixed = signals.join(F.broadcast(probs.select("date", F.posexplode("p").alias("regime", "prob"))), ["date", "regime"]).groupBy("date", "ticker").agg(F.sum(F.coalesce("signal", F.lit(0.0)) * F.col("prob")).alias("mix"))
    day = Window.partitionBy("date")
    best = mixed.withColumn("place", F.row_number().over(day.orderBy(F.desc("mix"), "ticker"))).where(F.col("place") <= top)
    w = best.withColumn("w", 1.0 / F.count("*").over(day)).where(F.col("w") >= min_weight)
    return w.select("date", "ticker", (F.col("w") / F.sum("w").over(day)).alias("weight"))


def blend_smooth(weights: DataFrame, dates: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponentially smoothed weights over the dense (date, ticker) grid, renormalised per date.

    Starts from the first date's weights; missing weights are 0. A ticker's past is in running sums.
    """
    grid = weights.select("ticker").distinct().crossJoin(F.broadcast(dates.select("date").distinct()))
    x = grid.join(weights, ["ticker", "date"], "left").select("ticker", "date", F.coalesce("weight", F.lit(0.0)).alias("x"))
    # the first row of a ticker's history starts the average, so it counts as if mixed in
    s = numbered(x).select("ticker", "date", (alpha * decayed_sum(F.when(F.col(ROW) == 0, F.col("x") / alpha).otherwise(F.col("x")), 1 - alpha)).alias("s"))
    day = Window.partitionBy("date")
    return s.where("s > 0").select("date", "ticker", (F.col("s") / F.sum("s").over(day)).alias("weight"))


def page_hinkley_step(s: Column, e: Column, threshold: float, floor: float, extreme: float, patience: int) -> Column:
    """One observation (date, ret, mu, sigma) folded into the state (m, alarms, at, n); a triggered state stays as it is."""
    sigma = F.greatest(e["sigma"], F.lit(1e-12))
    short = e["mu"] - e["ret"]
    m = F.greatest(F.lit(0.0), s["m"] + short - 0.5 * sigma)
    alarms = F.when(short > extreme * sigma, s["alarms"]).when((m > threshold) & (short > floor * sigma), s["alarms"] + 1).otherwise(0)
    missing = e["ret"].isNull()
    fresh = F.struct(
        F.when(missing, s["m"]).otherwise(m).alias("m"),
        F.when(missing, s["alarms"]).otherwise(alarms).alias("alarms"),
        F.when(~missing & (alarms >= patience), e["date"]).alias("at"),
        (s["n"] + 1).alias("n"),
    )
    return F.when(s["at"].isNotNull(), s).otherwise(fresh)


def page_hinkley(returns: DataFrame, threshold: float = 0.01, floor: float = 2.0, extreme: float = 3.5, patience: int = 5, keys: tuple[str, ...] = ("formula_id",)) -> DataFrame:
    """Decay alarm of each formula, folded over its returns in date order.

    ``returns``: keys, date, ret, and the expected mean ``mu`` and deviation ``sigma``. Shortfalls beyond half a
    deviation add up; a sum over ``threshold`` on a day that falls short by over ``floor`` deviations is an
    alarm; ``patience`` alarms in a row trigger and freeze the state; a shortfall over ``extreme`` deviations
    leaves the counter as it is. A formula's daily history is one short array.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", "ret", "mu", "sigma")))
    grouped = returns.groupBy(*keys).agg(rows.alias("rows"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("alarms"), F.lit(None).cast("date").alias("at"), F.lit(0).alias("n"))
    state = F.aggregate("rows", start, lambda s, e: page_hinkley_step(s, e, threshold, floor, extreme, patience))
    out = grouped.select(*keys, state.alias("s"))
    return out.select(*keys, F.col("s.m").alias("m"), F.col("s.alarms").alias("alarms"), F.col("s.at").isNotNull().alias("triggered"), F.col("s.at").alias("triggered_at"), F.col("s.n").alias("n_observations"))


def realized_pnl(trades: DataFrame, exits: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pending trades with their exit prices: gross and net return; jumps beyond ``limit`` stay pending.

    ``trades``: ticker, entry_px, exit_date, slippage_bps and more; ``exits``: ticker, date, pclose.
    """
    j = trades.drop("exit_px").join(exits.select("ticker", F.col("date").alias("exit_date"), F.col("pclose").alias("exit_px")), ["ticker", "exit_date"], "left")
    g = F.try_divide(F.col("exit_px"), F.col("entry_px")) - 1
    gross = F.when(F.abs(g) <= limit, g)
    return j.withColumn("gross_pnl_pct", gross).withColumn("net_pnl_pct", gross - F.col("slippage_bps") / 1e4)


def log_trades(candidates: DataFrame, max_slip: float = 200.0) -> DataFrame:
    """Rows fit for the ledger: positive weight and price, slippage capped."""
    return candidates.where("weight > 0 and entry_px > 0").withColumn("slippage_bps", F.least("slippage_bps", F.lit(max_slip)))


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.where("net_pnl_pct is not null").groupBy("date").agg(F.sum(F.col("net_pnl_pct") * F.col("weight")).alias("pnl"), F.count("*").alias("n"))


def drawdown(pnl: DataFrame) -> DataFrame:
    """Cumulative equity and drawdown of daily results; one row per day, so one small window."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = pnl.withColumn("equity", F.exp(F.sum(F.log1p("pnl")).over(w)))
    return e.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def gated(candidates: DataFrame, pnl: DataFrame, max_loss: float = 0.03, max_drawdown: float = 0.15) -> DataFrame:
    """Candidates of the days on which trading is allowed: not those after a day whose result or drawdown passed its limit.

    ``pnl(date, pnl)``: a row per day with results; a day's state holds until the next one's is known.
    """
    w = Window.orderBy("date")
    state = drawdown(pnl).withColumn("halted", (F.col("pnl") <= -max_loss) | (F.col("drawdown") <= -max_drawdown))
    spans = state.select(F.col("date").alias("__from"), F.lead("date").over(w).alias("__to"), "halted").where("halted")
    stopped = candidates.select("date").distinct().join(F.broadcast(spans), (F.col("date") > F.col("__from")) & (F.col("__to").isNull() | (F.col("date") <= F.col("__to")))).select("date")
    return candidates.join(F.broadcast(stopped), "date", "left_anti")


def actions(weights: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """BUY, SELL or HOLD of each (date, ticker) against the ticker's weight on the day before in the calendar."""
    days = weights.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))
    before = weights.join(F.broadcast(days), "date").where("next is not null").select(F.col("next").alias("date"), "ticker", F.col("weight").alias("prev_weight"))
    j = weights.select("date", "ticker", F.col("weight").alias("target_weight")).join(before, ["date", "ticker"], "full")
    j = j.na.fill(0.0, ["target_weight", "prev_weight"]).withColumn("weight_delta", F.col("target_weight") - F.col("prev_weight"))
    return j.withColumn("action", F.when(F.col("weight_delta") > tolerance, "BUY").when(F.col("weight_delta") < -tolerance, "SELL").otherwise("HOLD")).withColumn("turnover", F.abs("weight_delta"))


def report(acted: DataFrame, pnl: DataFrame, top: int = 15) -> DataFrame:
    """The last date's largest buys beside the whole period's return and share of winning days."""
    last = acted.agg(F.max("date").alias("date"))
    whole = pnl.agg((F.exp(F.sum(F.log1p("pnl"))) - 1).alias("total_return"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return acted.where("action = 'BUY'").join(F.broadcast(last), "date").orderBy(F.desc("target_weight"), "ticker").limit(top).crossJoin(F.broadcast(whole))
