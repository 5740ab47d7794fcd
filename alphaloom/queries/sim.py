"""Simulation, risk, ledgers, overfitting statistics, joins, search and streams."""

from __future__ import annotations

import math
import random
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ic, overfit, search, simulate
from ..plans.compiler import clip, evaluate, signals
from ..sources import panel as P
from ..sources.catalog import append, keep, shared_folder
from ..streaming import decay, paper
from ..streaming.decay import decay_stream, read_upserted, upsert_sink
from .common import MONTHLY, ORACLE, TS, WEEKLY, frame, monthly, query, rounded, weekly, with_ret
from .stats import _AVG, _BENCH, _CLIP, _POOL_SQL, _PROBS, POOL, pool_rows, probabilities

#: a plain daily portfolio, the equal-weighted half of names with the higher signal, as returns of each formula
_DAILY = f"""{_POOL_SQL}, pr AS (SELECT *, percent_rank() OVER (PARTITION BY formula_id, date ORDER BY signal DESC, ticker) AS pr FROM there), daily AS (SELECT formula_id, date, avg(greatest(least(ret, 0.5), -0.5)) FILTER (WHERE pr < 0.5) AS ret FROM pr GROUP BY formula_id, date)"""


def daily_returns(spark, d):
    w = F.percent_rank().over(Window.partitionBy("formula_id", "date").orderBy(F.desc("signal"), "ticker"))
    rows = pool_rows(spark, d).where("ret is not null").withColumn("pr", w)
    return rows.groupBy("formula_id", "date").agg(F.avg(F.when(F.col("pr") < 0.5, F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)))).alias("ret"))


@query("topk_first_day", f"WITH {_POOL_SQL}, f AS (SELECT formula_id, min(date) AS date FROM s GROUP BY formula_id), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.formula_id ORDER BY signal DESC, ticker DESC) AS place FROM s JOIN f USING (formula_id, date)) SELECT formula_id, ticker, date, place FROM r WHERE place <= 5")
def topk_first_day(spark, d):
    rows = pool_rows(spark, d)
    first = rows.groupBy("formula_id").agg(F.min("date").alias("date"))
    r = rows.join(first, ["formula_id", "date"]).withColumn("place", F.row_number().over(Window.partitionBy("formula_id").orderBy(F.desc("signal"), F.desc("ticker"))))
    return r.where("place <= 5").select("formula_id", "ticker", "date", "place")


@query("backtest_daily")
def backtest_daily(spark, d):
    return rounded(simulate.topk_dropout(pool_rows(spark, d), 5, 1), "ret")


@query("backtest_metrics")
def backtest_metrics(spark, d):
    out = simulate.metrics(simulate.equity(simulate.topk_dropout(pool_rows(spark, d), 5, 1)))
    return rounded(out, "net_return", "ir", "mdd", "annual", digits=4)


@query("backtest_risk")
def backtest_risk(spark, d):
    """The same portfolio with returns at target volatility, and slippage by volatility and traded value."""
    slip = simulate.unit_slippage(monthly(spark, d)).withColumn("slip", F.col("slip") / 1e4)
    rows = simulate.vol_targeted(pool_rows(spark, d).join(slip, ["ticker", "date"]))
    return rounded(simulate.topk_dropout(rows, 5, 1), "ret")


@query("backtest_walk_forward")
def backtest_walk_forward(spark, d):
    panel = with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose"))
    spans = overfit.windows(panel, 12, 12)
    rows = signals(overfit.in_windows(panel, spans), POOL, "ret", by=F.col("ticker.window_id"))
    flat = rows.select("formula_id", F.col("ticker.window_id").alias("window_id"), F.col("ticker.ticker").alias("ticker"), "date", "signal", "ret")
    return rounded(simulate.topk_dropout(flat, 5, 1, keys=("formula_id", "window_id")), "ret")


_CURVE = f"""{_DAILY}, eq AS (SELECT formula_id, date, ret, exp(sum(ln(1 + ret)) OVER w) AS e FROM daily WINDOW w AS (PARTITION BY formula_id ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, e / max(e) OVER (PARTITION BY formula_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq)"""


@query("equity_curve", f"WITH {_CURVE} SELECT formula_id, date, round(e, 6) AS equity, round(d, 6) + 0.0 AS drawdown FROM dd")
def equity_curve(spark, d):
    return rounded(simulate.equity(daily_returns(spark, d), start=1.0).select("formula_id", "date", "equity", "drawdown"), "equity", "drawdown")


@query(
    "equity_metrics",
    f"""WITH {_CURVE} SELECT formula_id, count(*) AS days, round((arg_max(e, date) - 1) * 100, 4) + 0.0 AS net_return, round(coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252.0), 0.0), 5) + 0.0 AS ir, round(min(d) * 100, 5) + 0.0 AS mdd FROM dd GROUP BY formula_id""",
)
def equity_metrics(spark, d):
    m = simulate.metrics(simulate.equity(daily_returns(spark, d), start=1.0), start=1.0)
    return rounded(rounded(m.select("formula_id", "days", "net_return", "ir", "mdd"), "ir", "mdd", digits=5), "net_return", digits=4)


@query(
    "benchmark_beta",
    f"""WITH {_DAILY}, {_BENCH}, bm AS (SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0.0) AS b FROM bench) SELECT formula_id, count(*) AS days, round(covar_samp(ret, b) / var_pop(b), 6) + 0.0 AS beta, round(avg(ret - b) / stddev_pop(ret - b) * sqrt(252.0), 5) + 0.0 AS alpha_ir FROM daily JOIN bm USING (date) GROUP BY formula_id""",
)
def benchmark_beta(spark, d):
    out = simulate.against_benchmark(daily_returns(spark, d), P.benchmark(monthly(spark, d)))
    return rounded(rounded(out.select("formula_id", "days", "beta", "alpha_ir"), "beta"), "alpha_ir", digits=5)


_ADV = f"""v0 AS (SELECT ticker, date, vlot * pclose AS v, row_number() OVER ({TS}) AS i FROM panel),
ew AS (SELECT a.ticker, a.date, sum(b.v * pow(9 / 11.0, a.i - b.i)) / sum(pow(9 / 11.0, a.i - b.i)) AS m FROM v0 a JOIN v0 b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY a.ticker, a.date),
va AS (SELECT ticker, date, least(CASE WHEN count(v) {frame(20)} >= 5 THEN avg(v) {frame(20)} END, CASE WHEN i >= 3 THEN m END) AS a FROM v0 JOIN ew USING (ticker, date)),
adv AS (SELECT ticker, date, lag(a) OVER ({TS}) AS adv FROM va)"""


@query("adv", f"WITH {MONTHLY}, {_ADV} SELECT ticker, date, round(adv, 3) AS adv FROM adv")
def adv(spark, d):
    return rounded(simulate.adv(monthly(spark, d)), "adv", digits=3)


@query("slippage_bps", f"WITH {MONTHLY}, {_ADV}, r AS (SELECT ticker, date, pclose / lag(pclose) OVER ({TS}) - 1 AS r FROM panel), sg AS (SELECT ticker, date, CASE WHEN count(r) {frame(6)} = 6 THEN stddev_samp(r) {frame(6)} END AS sigma FROM r) SELECT ticker, date, round(CASE WHEN sigma IS NOT NULL AND adv > 0 THEN 0.1 * sigma * sqrt(greatest(1000.0 / adv, 1e-4)) * 1e4 ELSE 10.0 END, 6) AS bps FROM adv JOIN sg USING (ticker, date)")
def slippage_bps(spark, d):
    p = evaluate(monthly(spark, d), {"r": "Sub(Div(Pclose, Ref(Pclose, 1)), 1)"}, raw=True)
    s = evaluate(p.withColumnRenamed("r", "popen_").drop("popen").withColumnRenamed("popen_", "popen"), {"sigma": "Std(Popen, 6)"}, raw=True).select("ticker", "date", "sigma")
    j = s.join(simulate.adv(monthly(spark, d)), ["ticker", "date"])
    return rounded(j.select("ticker", "date", simulate.slippage_bps(F.lit(0.1), F.col("sigma"), F.lit(1000.0), F.col("adv")).alias("bps")), "bps")


@query(
    "capacity",
    f"""WITH {_POOL_SQL}, {_ADV}, h AS (SELECT formula_id, ticker, date, adv, row_number() OVER (PARTITION BY formula_id, date ORDER BY signal DESC, ticker) AS place FROM s JOIN adv USING (ticker, date)),
a AS (SELECT * FROM h WHERE place <= 5 AND adv >= 10000), c AS (SELECT formula_id, ticker, adv * 0.05 * least(count(*) OVER (PARTITION BY formula_id, date), 20) AS cap FROM a)
SELECT formula_id, round(min(cap), 3) AS capacity, arg_min(ticker, cap) AS bottleneck, round(quantile_cont(cap, 0.5), 3) AS median_capacity, count(*) AS n FROM c GROUP BY formula_id""",
)
def capacity(spark, d):
    h = pool_rows(spark, d).join(simulate.adv(monthly(spark, d)), ["ticker", "date"]).withColumn("place", F.row_number().over(Window.partitionBy("formula_id", "date").orderBy(F.desc("signal"), "ticker"))).where("place <= 5 and adv >= 10000")
    return rounded(simulate.capacity(h, floor=10000), "capacity", "median_capacity", digits=3)


@query("slippage_calibration", "WITH t AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_quantity > 0) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS gamma FROM t")
def slippage_calibration(spark, d):
    t = P.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(simulate.calibrate_slippage(t).select("n", "gamma"), "gamma")


@query("unit_slippage", f"WITH {MONTHLY}, {_ADV}, r AS (SELECT ticker, date, pclose / lag(pclose) OVER ({TS}) - 1 AS r FROM panel), sg AS (SELECT ticker, date, CASE WHEN count(r) {frame(20)} >= 5 THEN stddev_samp(r) {frame(20)} END AS sigma FROM r) SELECT ticker, date, round(coalesce(0.1 * sigma * sqrt(1.0 / nullif(adv, 0)) * 1e4, 10.0), 6) AS slip FROM adv JOIN sg USING (ticker, date)")
def unit_slippage(spark, d):
    return rounded(simulate.unit_slippage(monthly(spark, d)), "slip")


#: the weighted deviation as a self-join: weights (2/3) to the rows' distance, corrected for bias
_SCALE = f"""v0 AS (SELECT ticker, date, pclose / lag(pclose) OVER ({TS}) - 1 AS r, row_number() OVER ({TS}) AS i FROM panel),
v1 AS (SELECT a.ticker, a.date, sum(pow(2 / 3.0, a.i - b.i)) AS w, sum(pow(4 / 9.0, a.i - b.i)) AS w2, sum(pow(2 / 3.0, a.i - b.i) * b.r) AS wr, sum(pow(2 / 3.0, a.i - b.i) * b.r * b.r) AS wrr FROM v0 a JOIN v0 b ON a.ticker = b.ticker AND b.i <= a.i AND b.r IS NOT NULL GROUP BY a.ticker, a.date),
v2 AS (SELECT ticker, date, CASE WHEN w - w2 / w > 1e-12 THEN sqrt(greatest(wrr - wr * wr / w, 0) / (w - w2 / w)) END AS e FROM v1),
v3 AS (SELECT ticker, date, greatest(CASE WHEN count(r) {frame(20)} >= 5 THEN stddev_samp(r) {frame(20)} END, e) * sqrt(252.0) AS v FROM v0 LEFT JOIN v2 USING (ticker, date)),
v4 AS (SELECT ticker, date, CASE WHEN v IS NULL OR v = 0 THEN 1.0 ELSE greatest(0.1, least(3.0, 0.15 / v)) END AS s FROM v3)"""


@query("vol_target_scale", f"WITH {MONTHLY}, {_SCALE} SELECT ticker, date, round(coalesce(lag(s) OVER ({TS}), 1.0), 6) AS scale FROM v4")
def vol_target_scale(spark, d):
    return rounded(simulate.vol_scale(monthly(spark, d)), "scale")


def _regime_signals(spark, d):
    rows = pool_rows(spark, d)
    number = F.when(F.col("formula_id") == "momentum", 0).when(F.col("formula_id") == "level", 1).otherwise(2)
    return rows.select(number.alias("regime"), "ticker", "date", "signal")


_BLEND = f"""{_POOL_SQL}, {_PROBS}, mix AS (SELECT s.date, ticker, sum(signal * CASE formula_id WHEN 'momentum' THEN p0 WHEN 'level' THEN p1 ELSE p2 END) AS mix FROM s JOIN probs USING (date) GROUP BY s.date, ticker),
best AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mix, 9) DESC, ticker) AS place FROM mix)"""


@query("blend_weights_raw", f"WITH {_BLEND} SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM best WHERE place <= 5")
def blend_weights_raw(spark, d):
    s = _regime_signals(spark, d)
    return rounded(simulate.blend_raw(s, probabilities(spark, d), 5), "weight")


_SMOOTH = f"""{_BLEND}, tw AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM best WHERE place <= 5), dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)),
x AS (SELECT t.ticker, dn.date, dn.i, coalesce(w, 0.0) AS x FROM (SELECT DISTINCT ticker FROM tw) t CROSS JOIN dn LEFT JOIN tw ON tw.ticker = t.ticker AND tw.date = dn.date),
sm AS (SELECT a.ticker, a.date, sum(b.x * CASE WHEN b.i = 0 THEN pow(0.7, a.i) ELSE 0.3 * pow(0.7, a.i - b.i) END) AS s FROM x a JOIN x b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY a.ticker, a.date)"""


@query("blend_weights_ema", f"WITH {_SMOOTH} SELECT date, ticker, round(s / sum(s) OVER (PARTITION BY date), 6) + 0.0 AS weight FROM sm WHERE s > 0")
def blend_weights_ema(spark, d):
    raw = simulate.blend_raw(_regime_signals(spark, d), probabilities(spark, d), 5)
    return rounded(simulate.blend_smooth(raw, monthly(spark, d).select("date")), "weight")


_ACT = f"""{_BLEND}, tw AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM best WHERE place <= 5), cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM tw)),
prev AS (SELECT nxt AS date, ticker, w AS p FROM tw JOIN cal USING (date) WHERE nxt IS NOT NULL), act AS (SELECT date, ticker, coalesce(w, 0.0) AS target_weight, coalesce(p, 0.0) AS prev_weight FROM tw FULL JOIN prev USING (date, ticker))"""


@query("forensics_actions", f"WITH {_ACT} SELECT date, ticker, round(target_weight, 6) AS target_weight, round(prev_weight, 6) AS prev_weight, CASE WHEN target_weight - prev_weight > 1e-4 THEN 'BUY' WHEN target_weight - prev_weight < -1e-4 THEN 'SELL' ELSE 'HOLD' END AS action FROM act")
def forensics_actions(spark, d):
    raw = simulate.blend_raw(_regime_signals(spark, d), probabilities(spark, d), 5)
    return rounded(simulate.actions(raw).select("date", "ticker", "target_weight", "prev_weight", "action"), "target_weight", "prev_weight")


#: a ledger derived from the panel: bought at the close, left two trading days on
_LEDGER = f"""{MONTHLY}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), tr AS (SELECT p.ticker, p.date, p.pclose AS entry_px, 20.0 AS slippage_bps, 0.1 AS weight, e.date AS exit_date FROM panel p JOIN days USING (date) LEFT JOIN days e ON e.i = days.i + 2),
pnl AS (SELECT t.ticker, t.date, t.exit_date, t.weight, CASE WHEN abs(x.pclose / entry_px - 1) <= 0.5 THEN x.pclose / entry_px - 1 END AS gross, slippage_bps FROM tr t LEFT JOIN panel x ON x.ticker = t.ticker AND x.date = t.exit_date)"""


def ledger(spark, d):
    p = keep(monthly(spark, d).select("ticker", "date", "pclose"), "panel")  # entries, calendar and exits read it
    t = P.exit_dates(p.select("ticker", "date", F.col("pclose").alias("entry_px")), P.trading_calendar(p), 2)
    t = simulate.log_trades(t.withColumn("slippage_bps", F.lit(20.0)).withColumn("weight", F.lit(0.1)))
    return simulate.realized_pnl(t, p)


@query("forward_exit_join", f"WITH {_LEDGER} SELECT ticker, date, exit_date FROM tr")
def forward_exit_join(spark, d):
    return ledger(spark, d).select("ticker", "date", "exit_date")


@query("paper_realized_pnl", f"WITH {_LEDGER} SELECT ticker, date, round(gross, 6) + 0.0 AS gross_pnl_pct, round(gross - slippage_bps / 1e4, 6) + 0.0 AS net_pnl_pct FROM pnl")
def paper_realized_pnl(spark, d):
    return rounded(ledger(spark, d).select("ticker", "date", "gross_pnl_pct", "net_pnl_pct"), "gross_pnl_pct", "net_pnl_pct")


_DAYPNL = f"{_LEDGER}, dp AS (SELECT date, sum((gross - slippage_bps / 1e4) * weight) AS pnl, count(*) AS n FROM pnl WHERE gross IS NOT NULL GROUP BY date)"


@query("daily_loss", f"WITH {_DAYPNL} SELECT date, round(pnl, 6) + 0.0 AS pnl, n, pnl <= -0.03 AS halted FROM dp")
def daily_loss(spark, d):
    p = simulate.daily_pnl(ledger(spark, d)).withColumn("halted", F.col("pnl") <= -0.03)
    return rounded(p, "pnl")


def _scaled(spark, d):
    # the mean trade of the day, so that no day can lose all
    return _mean_pnl(ledger(spark, d))


def _mean_pnl(trades):
    p = simulate.daily_pnl(trades)
    return p.select("date", (F.col("pnl") / F.col("n")).alias("pnl"))


@query("drawdown", f"WITH {_DAYPNL}, e AS (SELECT date, exp(sum(ln(1 + pnl / n)) OVER (ORDER BY date)) AS e FROM dp) SELECT date, round(e, 6) AS equity, round(e / max(e) OVER (ORDER BY date) - 1, 6) + 0.0 AS drawdown FROM e")
def drawdown(spark, d):
    return rounded(simulate.drawdown(_scaled(spark, d)).select("date", "equity", "drawdown"), "equity", "drawdown")


def _live(spark, d):
    r = daily_returns(spark, d)
    stats = r.groupBy("formula_id").agg((F.avg("ret") + 0.6 * F.stddev_samp("ret")).alias("mu"), (F.stddev_samp("ret") / 4).alias("sigma"))
    return r.join(F.broadcast(stats), "formula_id")


@query(
    "decay_page_hinkley",
    f"""WITH RECURSIVE {_DAILY}, st AS (SELECT formula_id, avg(ret) + 0.6 * stddev_samp(ret) AS mu, stddev_samp(ret) / 4 AS sigma FROM daily GROUP BY formula_id), o AS (SELECT d.formula_id, d.date, d.ret, mu, sigma, row_number() OVER (PARTITION BY d.formula_id ORDER BY d.date) AS i FROM daily d JOIN st USING (formula_id)),
f AS (SELECT formula_id, 0 AS i, 0e0 AS m, 0 AS alarms, CAST(NULL AS DATE) AS hit, 0 AS n FROM st UNION ALL
SELECT o.formula_id, o.i, CASE WHEN f.hit IS NOT NULL THEN f.m ELSE greatest(0e0, f.m + mu - ret - 0.5 * sigma) END,
CASE WHEN f.hit IS NOT NULL THEN f.alarms WHEN mu - ret > 3.5 * sigma THEN f.alarms WHEN greatest(0e0, f.m + mu - ret - 0.5 * sigma) > 0.01 AND mu - ret > 2.0 * sigma THEN f.alarms + 1 ELSE 0 END,
CASE WHEN f.hit IS NOT NULL THEN f.hit WHEN (CASE WHEN mu - ret > 3.5 * sigma THEN f.alarms WHEN greatest(0e0, f.m + mu - ret - 0.5 * sigma) > 0.01 AND mu - ret > 2.0 * sigma THEN f.alarms + 1 ELSE 0 END) >= 2 THEN o.date END,
CASE WHEN f.hit IS NOT NULL THEN f.n ELSE f.n + 1 END FROM f JOIN o ON o.formula_id = f.formula_id AND o.i = f.i + 1)
SELECT formula_id, round(arg_max(m, i), 6) + 0.0 AS m, arg_max(alarms, i) AS alarms, max(hit) IS NOT NULL AS triggered, max(hit) AS triggered_at, arg_max(n, i) AS n_observations FROM f GROUP BY formula_id""",
)
def decay_page_hinkley(spark, d):
    return rounded(simulate.page_hinkley(_live(spark, d), patience=2), "m")


_REPORT = f"""{_ACT}, {_DAYPNL.replace(MONTHLY + ', ', '', 1)}, whole AS (SELECT exp(sum(ln(1 + pnl / n))) - 1 AS total_return, avg(CASE WHEN pnl / n > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM dp),
buys AS (SELECT * FROM act WHERE target_weight - prev_weight > 1e-4 AND date = (SELECT max(date) FROM act) ORDER BY target_weight DESC, ticker LIMIT 15)"""


@query(
    "portfolio_report",
    f"WITH {_REPORT} SELECT date, ticker, round(target_weight, 6) AS target_weight, round(prev_weight, 6) AS prev_weight, round(target_weight - prev_weight, 6) AS weight_delta, 'BUY' AS action, round(abs(target_weight - prev_weight), 6) AS turnover, round(total_return, 6) + 0.0 AS total_return, round(win_rate, 6) AS win_rate FROM buys, whole",
)
def portfolio_report(spark, d):
    raw = simulate.blend_raw(_regime_signals(spark, d), probabilities(spark, d), 5)
    return rounded(simulate.report(simulate.actions(raw), _scaled(spark, d)), "target_weight", "prev_weight", "weight_delta", "turnover", "total_return", "win_rate")


def _sliced_sql(slices: int) -> str:
    return f"""{_DAILY}, si AS (SELECT formula_id, ret, row_number() OVER (PARTITION BY formula_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY formula_id) AS n FROM daily),
sl AS (SELECT formula_id, {' + '.join(f'CASE WHEN i >= floor(n * {k} / {slices}.0) THEN 1 ELSE 0 END' for k in range(1, slices))} AS slice, ret FROM si), sliced AS (SELECT formula_id, slice, avg(ret) AS pnl FROM sl GROUP BY formula_id, slice)"""


_SLICES = _sliced_sql(6)


@query("pnl_slices", f"WITH {_SLICES} SELECT formula_id, slice, round(pnl, 6) + 0.0 AS pnl FROM sliced")
def pnl_slices(spark, d):
    return rounded(overfit.pnl_slices(daily_returns(spark, d), 6), "pnl")


def _combo_values() -> str:
    from itertools import combinations

    return ", ".join(f"({c}, {s}, {str(s in inside).lower()})" for c, inside in enumerate(combinations(range(6), 3)) for s in range(6))


_PBO = f"""{_SLICES}, combos AS (SELECT * FROM (VALUES {_combo_values()}) t(combo, slice, inside)),
m AS (SELECT combo, formula_id, avg(pnl) FILTER (WHERE inside) AS is_mean, avg(pnl) FILTER (WHERE NOT inside) AS oos_mean FROM sliced JOIN combos USING (slice) GROUP BY combo, formula_id),
bb AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY is_mean DESC, formula_id DESC) AS place, count(*) OVER (PARTITION BY combo) AS s FROM m),
w AS (SELECT bb.combo, bb.formula_id AS best, bb.is_mean, bb.oos_mean, (SELECT count(*) FROM m WHERE m.combo = bb.combo AND m.oos_mean > bb.oos_mean) / CAST(greatest(s - 1, 1) AS DOUBLE) AS omega FROM bb WHERE place = 1)"""


@query("pbo_combos", f"WITH {_PBO} SELECT combo, best, round(is_mean, 6) + 0.0 AS is_mean, round(oos_mean, 6) + 0.0 AS oos_mean, round(omega, 6) AS omega FROM w")
def pbo_combos(spark, d):
    found = overfit.pbo_combos(overfit.pnl_slices(daily_returns(spark, d), 6), overfit.splits(spark, 6))
    return rounded(found.select("combo", "best", "is_mean", "oos_mean", "omega"), "is_mean", "oos_mean", "omega")


@query("pbo_cscv", f"WITH {_PBO} SELECT round(avg(CASE WHEN omega > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_combinations, round(avg(is_mean), 6) + 0.0 AS is_mean, round(avg(oos_mean), 6) + 0.0 AS oos_mean, CASE WHEN avg(CASE WHEN omega > 0.5 THEN 1.0 ELSE 0.0 END) < 0.5 THEN 'low' WHEN avg(CASE WHEN omega > 0.5 THEN 1.0 ELSE 0.0 END) < 0.7 THEN 'medium' ELSE 'high' END AS verdict FROM w")
def pbo_cscv(spark, d):
    found = overfit.pbo_combos(overfit.pnl_slices(daily_returns(spark, d), 6), overfit.splits(spark, 6))
    return rounded(overfit.pbo(found).drop("degradation"), "pbo", "is_mean", "oos_mean")


def _sampled_sql(slices: int, most: int, seed: int) -> str:
    """The same numbered ways to take half of the slices, one for each part of the range, unranked slice by slice."""
    half = slices // 2
    return f"""{_sliced_sql(slices)}, size AS (SELECT (factorial({slices}) // factorial({half}) // factorial({slices - half}))::BIGINT AS total),
ranks AS (SELECT i AS combo, i * (total // {most}) + least(i, total % {most}) + ('0x' || substr(md5('{seed}:' || i), 1, 15))::BIGINT % (total // {most} + CASE WHEN i < total % {most} THEN 1 ELSE 0 END) AS r FROM size, range({most}) t(i)),
ways AS (SELECT n, k, (factorial(n::INTEGER) // factorial(k::INTEGER) // factorial((n - k)::INTEGER))::BIGINT AS c FROM range({slices}) a(n), range({half + 1}) b(k) WHERE k <= n),
u AS (SELECT combo, -1 AS slice, r, {half} AS k, false AS inside FROM ranks UNION ALL
SELECT combo, u.slice + 1, CASE WHEN u.r < coalesce(c, 0) THEN u.r ELSE u.r - coalesce(c, 0) END, CASE WHEN u.r < coalesce(c, 0) THEN u.k - 1 ELSE u.k END, u.r < coalesce(c, 0)
FROM u LEFT JOIN ways ON n = {slices - 2} - u.slice AND ways.k = u.k - 1 WHERE u.slice < {slices - 1}),
combos AS (SELECT combo, slice, inside FROM u WHERE slice >= 0)"""


@query("pbo_sampled", f"WITH RECURSIVE {_sampled_sql(30, 200, 42)}, {_PBO[_PBO.index('m AS (SELECT combo'):]} SELECT CAST(combo AS INTEGER) AS combo, best, round(is_mean, 6) + 0.0 AS is_mean, round(oos_mean, 6) + 0.0 AS oos_mean, round(omega, 6) AS omega FROM w")
def pbo_sampled(spark, d):
    """A sample of 200 of the 155 million ways to take half of 30 slices."""
    found = overfit.pbo_combos(overfit.pnl_slices(daily_returns(spark, d), 30), overfit.splits(spark, 30, most=200))
    return rounded(found.select("combo", "best", "is_mean", "oos_mean", "omega"), "is_mean", "oos_mean", "omega")


@query("pbo_single", f"WITH {_PBO} SELECT formula_id, round(avg(CASE WHEN is_mean > 0 AND oos_mean <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM m GROUP BY formula_id")
def pbo_single(spark, d):
    return rounded(overfit.single_pbo(overfit.pnl_slices(daily_returns(spark, d), 6), overfit.splits(spark, 6)), "pbo")


@query("dsr_inputs", f"WITH {_DAILY} SELECT formula_id, count(ret) AS days, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 5) + 0.0 AS sharpe, round((avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3), 5) + 0.0 AS skew, round(kurtosis_pop(ret), 5) + 0.0 AS kurt FROM daily GROUP BY formula_id")
def dsr_inputs(spark, d):
    return rounded(overfit.sharpe_inputs(daily_returns(spark, d)), "sharpe", "skew", "kurt", digits=5)


def _cdf_sql(z: str) -> str:
    """The same rational approximation of the normal distribution function as ``overfit.normal_cdf``."""
    x, t = f"(abs({z}) / sqrt(2.0))", f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    half = f"0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {half} ELSE {half} END"


_SR = f"""{_DAILY}, sr AS (SELECT formula_id, count(ret) AS days, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe, (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3) AS skew, kurtosis_pop(ret) AS kurt FROM daily GROUP BY formula_id)"""
_DSR = f"""{_SR}, z0 AS (SELECT *, {overfit.best_of_noise(362)!r} / sqrt(days) AS null_sharpe FROM sr), z AS (SELECT *, (sharpe - null_sharpe) / sqrt(greatest((1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / days, 1.0 / days)) AS z FROM z0)"""


def _four(df):
    return rounded(rounded(df, "sharpe", "z", "p", digits=4), "skew", "kurt", digits=5)


@query("dsr_table", f"WITH {_DSR} SELECT formula_id, days, round(sharpe, 4) + 0.0 AS sharpe, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt, round(null_sharpe, 6) AS null_sharpe, round(z, 4) + 0.0 AS z, round({_cdf_sql('z')}, 4) + 0.0 AS p, {_cdf_sql('z')} >= 0.95 AS significant FROM z")
def dsr_table(spark, d):
    return rounded(_four(overfit.deflated_sharpe(overfit.sharpe_inputs(daily_returns(spark, d)), 362)), "null_sharpe")


_NULL = (1 - overfit.EULER) * math.sqrt(2 * math.log(362)) + overfit.EULER / math.sqrt(2 * math.log(362))
_SIMPLE = f"""{_SR}, z0 AS (SELECT *, (1 + 0.5 * sharpe * sharpe - skew * sharpe + kurt / 4 * sharpe * sharpe) / greatest(days, 252) AS inner_ FROM sr), z AS (SELECT *, coalesce((sharpe - {_NULL!r}) / (sqrt(CASE WHEN inner_ > 0 THEN inner_ END) + 1e-10), 0.0) AS z FROM z0)"""


@query("dsr_simple", f"WITH {_SIMPLE} SELECT formula_id, days, round(sharpe, 4) + 0.0 AS sharpe, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt, round(z, 4) + 0.0 AS z, round({_cdf_sql('z')}, 4) + 0.0 AS p FROM z")
def dsr_simple(spark, d):
    return _four(overfit.simple_deflated_sharpe(overfit.sharpe_inputs(daily_returns(spark, d))))


@query("ensemble_rank_average", f"WITH {_POOL_SQL}, p AS (SELECT ticker, date, {_AVG.format('formula_id, date', 'signal')} / count(signal) OVER (PARTITION BY formula_id, date) AS v FROM s) SELECT ticker, date, round(sum(v / 3), 9) + 0.0 AS signal FROM p GROUP BY ticker, date HAVING count(*) = 3")
def ensemble_rank_average(spark, d):
    return rounded(overfit.combine(pool_rows(spark, d)), "signal", digits=9)


_WIDE = "wide AS (SELECT ticker, date, any_value(signal) FILTER (WHERE formula_id = 'momentum') AS momentum, any_value(signal) FILTER (WHERE formula_id = 'level') AS level, any_value(signal) FILTER (WHERE formula_id = 'trend') AS trend FROM s GROUP BY ticker, date)"


def pool_columns(spark, d):
    return clip(evaluate(monthly(spark, d), POOL), list(POOL))


@query("ensemble_corr_matrix", f"WITH {_POOL_SQL}, {_WIDE} SELECT 'momentum' AS a, 'level' AS b, round(corr(momentum, level), 6) + 0.0 AS corr FROM wide UNION ALL SELECT 'momentum', 'trend', round(corr(momentum, trend), 6) + 0.0 FROM wide UNION ALL SELECT 'level', 'trend', round(corr(level, trend), 6) + 0.0 FROM wide")
def ensemble_corr_matrix(spark, d):
    return rounded(overfit.correlations(pool_columns(spark, d), list(POOL)), "corr")


_GREEDY = f"""{_POOL_SQL}, {_WIDE}, c AS (SELECT abs(coalesce(corr(momentum, level), 0)) < 0.7 AS ml, abs(coalesce(corr(momentum, trend), 0)) < 0.7 AS mt, abs(coalesce(corr(level, trend), 0)) < 0.7 AS lt FROM wide),
k AS (SELECT 0 AS o, 'momentum' AS formula_id, true AS keep UNION ALL SELECT 1, 'level', ml FROM c UNION ALL SELECT 2, 'trend', mt AND (NOT ml OR lt) FROM c)"""


@query("ensemble_greedy", f"WITH {_GREEDY} SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS place, formula_id FROM k WHERE keep")
def ensemble_greedy(spark, d):
    kept = overfit.greedy_pool(pool_columns(spark, d), list(POOL))
    return spark.createDataFrame([(i, k) for i, k in enumerate(kept)], "place int, formula_id string")


_CUT = "DATE '2000-01-01'"


@query(
    "overfit_table",
    f"""WITH {_POOL_SQL}, t AS (SELECT formula_id, avg(rank_ic) FILTER (WHERE date < {_CUT}) AS a, avg(rank_ic) FILTER (WHERE date >= {_CUT}) AS b FROM ics GROUP BY formula_id) SELECT formula_id, round(a, 6) + 0.0 AS train_ric, round(b, 6) + 0.0 AS test_ric, round((b - a) / abs(a), 4) + 0.0 AS degradation, coalesce((b - a) / abs(a) > -0.5, false) AS passed FROM t""",
)
def overfit_table(spark, d):
    days = ic.daily(pool_rows(spark, d))
    cut = F.lit("2000-01-01").cast("date")
    out = overfit.overfit_table(ic.summary(days.where(F.col("date") < cut)), ic.summary(days.where(F.col("date") >= cut)))
    return rounded(rounded(out, "train_ric", "test_ric"), "degradation", digits=4)


_WINS = "spans AS (SELECT * FROM (VALUES (0, DATE '1998-01-01', DATE '1999-01-01'), (1, DATE '1999-01-01', DATE '2000-01-01'), (2, DATE '2000-01-01', DATE '2001-01-01')) t(window_id, s0, s1))"


@query(
    "rolling_wf_ic",
    f"""WITH {MONTHLY}, {_WINS}, x AS (SELECT window_id, ticker, date, pclose FROM panel, spans WHERE date >= s0 AND date < s1),
y0 AS (SELECT *, coalesce(pclose - lag(pclose, 3) OVER w, 0.0) AS signal, lead(pclose, 2) OVER w / lead(pclose, 1) OVER w - 1 AS ret FROM x WINDOW w AS (PARTITION BY window_id, ticker ORDER BY date)), {_CLIP.format('y', 'y0', 'window_id')},
k AS (SELECT *, {_AVG.format('window_id, date', 'signal')} AS a, {_AVG.format('window_id, date', 'ret')} AS b FROM y WHERE ret IS NOT NULL),
dd AS (SELECT window_id, date, CASE WHEN count(*) < 2 THEN NULL WHEN min(a) = max(a) THEN 0.0 WHEN min(b) = max(b) THEN NULL ELSE covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END AS ic FROM k GROUP BY window_id, date)
SELECT window_id, round(avg(ic), 6) + 0.0 AS rank_ic, count(ic) AS days FROM dd GROUP BY window_id""",
)
def rolling_wf_ic(spark, d):
    spans = spark.sql("select * from values (0, date'1998-01-01', date'1999-01-01'), (1, date'1999-01-01', date'2000-01-01'), (2, date'2000-01-01', date'2001-01-01') t(window_id, start, end)")
    inside = with_ret(overfit.in_windows(monthly(spark, d), spans))
    rows = signals(inside, {"f": "Delta(Pclose, 3)"}, "ret", by=F.col("ticker.window_id")).withColumn("window_id", F.col("ticker.window_id"))
    return rounded(ic.summary(ic.daily(rows, "ret", "window_id"), "window_id").select("window_id", "rank_ic", "days"), "rank_ic")


@query("asof_benchmark", f"WITH {WEEKLY}, o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders), m AS (SELECT date, sum(pclose * vlot) / sum(vlot) AS close FROM panel GROUP BY date) SELECT o_orderkey, o.date, round(m.close, 5) AS close FROM o ASOF LEFT JOIN m ON o.date >= m.date")
def asof_benchmark(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.lit(1).alias("k"))
    # one series for all rows: dates are few, so orders are joined to the day's value, found as of each distinct day
    days = o.select("date", "k").distinct()
    b = P.benchmark(weekly(spark, d)).select(F.lit(1).alias("k"), F.col("date").alias("at"), "close")
    found = P.as_of(days, b, ["k"], "date", "at", ["close"]).select("date", "close")
    return rounded(o.drop("k").join(F.broadcast(found), "date", "left").select("o_orderkey", "date", "close"), "close", digits=5)


@query(
    "asof_fundamental_lag45",
    f"""WITH {MONTHLY}, f AS (SELECT o_custkey % 10 AS ticker, CAST(o_orderdate AS DATE) + 45 AS at, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT p.ticker, p.date, round(f.v, 4) AS v FROM panel p ASOF LEFT JOIN f ON p.ticker = f.ticker AND p.date >= f.at""",
)
def asof_fundamental_lag45(spark, d):
    f = P.table(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("ticker"), F.date_add(F.to_date("o_orderdate"), 45).alias("at")).agg(F.max("o_totalprice").alias("v"))
    return rounded(P.as_of(monthly(spark, d).select("ticker", "date"), f, ["ticker"], "date", "at", ["v"]), "v", digits=4)


@query("mining_window")
def mining_window(spark, d):
    panel = with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose"))
    return rounded(search.score_pool(panel, search.breed(random.Random(42), [], 6, 6)).select("formula", "status", "mean_ric", "fitness", "verdict"), "mean_ric", "fitness")


@query("stream_decay", ORACLE["decay_page_hinkley"])
def stream_decay(spark, d):
    """The decay state kept by a stream over files, read until they end, its results upserted by formula."""
    base = f"{shared_folder(spark)}/decay-{uuid.uuid4().hex[:12]}"
    rows = _live(spark, d).withColumn("date", F.col("date").cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    q = decay_stream(stream, patience=2).writeStream.outputMode("update").foreachBatch(upsert_sink(f"{base}/out", ["formula_id"])).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(read_upserted(spark, f"{base}/out", ["formula_id"]), "m").withColumn("triggered_at", F.to_date("triggered_at"))


@query("stream_paper_pnl", ORACLE["paper_realized_pnl"])
def stream_paper_pnl(spark, d):
    """The ledger's trades filled by a stream of prices that stops half-way and is started again; unfilled ones come out at the end."""
    base = f"{shared_folder(spark)}/paper-{uuid.uuid4().hex[:12]}"
    panel = keep(monthly(spark, d).select("ticker", "date", "pclose"), "panel")
    days = F.broadcast(P.trading_calendar(panel).withColumnRenamed("idx", "day"))  # a row per day
    dated = panel.join(days, "date").withColumn("date", F.col("date").cast("timestamp"))
    entries = simulate.log_trades(dated.select("ticker", "date", (F.col("day") + 2).alias("exit_day"), F.col("pclose").alias("entry_px"), F.lit(0.1).alias("weight"), F.lit(20.0).alias("slippage_bps")))
    prices = dated.select("ticker", "date", "day", "pclose")
    half = panel.agg(F.date_add(F.min("date"), F.floor(F.date_diff(F.max("date"), F.min("date")) / 2).cast("int")).alias("half"), F.date_add(F.max("date"), 400).alias("end")).first()
    for part in (f"date < '{half.half}'", f"date >= '{half.half}'", None):
        for name, rows in (("entries", entries), ("prices", prices)):
            (paper.heartbeat(rows, str(half.end)) if part is None else rows.where(part)).write.mode("append").parquet(f"{base}/{name}")
        streams = [spark.readStream.schema(rows.schema).parquet(f"{base}/{name}") for name, rows in (("entries", entries), ("prices", prices))]
        out = paper.fills(*streams).writeStream.outputMode("append").foreachBatch(upsert_sink(f"{base}/out", ["ticker", "date"]))
        out.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = read_upserted(spark, f"{base}/out", ["ticker", "date"]).withColumn("date", F.to_date("date"))
    return rounded(out.select("ticker", "date", "gross_pnl_pct", "net_pnl_pct"), "gross_pnl_pct", "net_pnl_pct")


@query(
    "stream_kill_switch",
    f"""WITH {_DAYPNL}, a AS (SELECT CAST(date AS TIMESTAMP) AS t FROM dp WHERE pnl <= -0.03)
SELECT 'book' AS account, t AS "at", 'on' AS turned, 'daily loss' AS reason FROM a UNION ALL SELECT 'book', t + INTERVAL 24 HOUR, 'off', 'daily loss' FROM a""",
)
def stream_kill_switch(spark, d):
    """Days of a loss beyond the limit stop the book for 24 hours; half the stops end by a later alarm, the last one by its timer."""
    base = f"{shared_folder(spark)}/switch-{uuid.uuid4().hex[:12]}"
    alarms = simulate.daily_pnl(ledger(spark, d)).where("pnl <= -0.03").select(F.lit("book").alias("account"), F.col("date").cast("timestamp").alias("at"), F.lit("daily loss").alias("reason"))
    end = alarms.agg(F.max("at") + F.expr("interval 3 days")).first()[0]
    for rows in (alarms, paper.heartbeat(alarms, str(end or "2000-01-01"), "at").withColumn("account", F.lit("clock"))):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = decay.kill_switch(spark.readStream.schema(alarms.schema).parquet(f"{base}/in")).where("account <> 'clock'")
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out", format="parquet").awaitTermination()
    return spark.read.schema("account string, at timestamp, turned string, reason string").parquet(f"{base}/out")


@query("stream_windowed_pnl", f"WITH {_DAYPNL} SELECT date, round(pnl, 6) + 0.0 AS pnl, n FROM dp")
def stream_windowed_pnl(spark, d):
    """Weighted results of the ledger's filled trades by day, as a stream that a watermark closes."""
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex[:12]}"
    trades = ledger(spark, d).where("net_pnl_pct is not null").select(F.col("date").cast("timestamp").alias("date"), "net_pnl_pct", "weight")
    end = trades.agg(F.max("date") + F.expr("interval 30 days")).first()[0]
    for rows in (trades, paper.heartbeat(trades, str(end or "2000-01-01"))):
        rows.write.mode("append").parquet(f"{base}/in")
    stream = decay.windowed_pnl(spark.readStream.schema(trades.schema).parquet(f"{base}/in"))
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out", format="parquet").awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{base}/out").select(F.to_date("window.start").alias("date"), "pnl", "n"), "pnl")


@query(
    "paper_ledger_gated",
    f"""WITH {_DAYPNL}, e AS (SELECT date, pnl / n AS pnl, exp(sum(ln(1 + pnl / n)) OVER (ORDER BY date)) AS e FROM dp), h AS (SELECT date, pnl <= -0.03 OR e / max(e) OVER (ORDER BY date) - 1 <= -0.9 AS halted, lead(date) OVER (ORDER BY date) AS nxt FROM e)
SELECT ticker, date, round(entry_px, 6) AS entry_px, weight FROM tr WHERE NOT EXISTS (SELECT 1 FROM h WHERE halted AND tr.date > h.date AND (nxt IS NULL OR tr.date <= nxt))""",
)
def paper_ledger_gated(spark, d):
    """What gets into the ledger when days of loss and drawdown stop the next day's trades; appended and read again."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex[:12]}"
    trades = keep(ledger(spark, d).select("ticker", "date", "entry_px", "weight", "net_pnl_pct"), "trades")
    kept = simulate.gated(trades.select("ticker", "date", "entry_px", "weight"), _mean_pnl(trades), max_drawdown=0.9)
    for part in ("date < '1998-01-01'", "date >= '1998-01-01'"):
        append(kept.where(part), path)
    return rounded(spark.read.schema(kept.schema).parquet(path), "entry_px")
