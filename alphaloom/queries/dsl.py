"""Panels and every operator of the formula language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.compiler import clip, evaluate
from ..sources import panel as P
from .common import MONTHLY, ORACLE, QUERIES, RET, TS, WEEKLY, frame, monthly, query, rounded, weekly, with_ret

_PRICES = ("popen", "phigh", "plow", "pclose", "ptyp")
_R = ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in _PRICES)


@query("panel_monthly", f"WITH {MONTHLY} SELECT ticker, date, {_R}, vlot FROM panel")
def panel_monthly(spark, d):
    return rounded(monthly(spark, d), *_PRICES, digits=7).select("ticker", "date", *_PRICES, "vlot")


@query("panel_weekly", f"WITH {WEEKLY} SELECT ticker, date, {_R}, vlot FROM panel")
def panel_weekly(spark, d):
    return rounded(weekly(spark, d), *_PRICES, digits=7).select("ticker", "date", *_PRICES, "vlot")


@query(
    "panel_events",
    """WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, value, ts, event_id FROM events)
SELECT ticker, date, round(first(value ORDER BY ts, event_id), 7) + 0.0 AS popen, round(max(value), 7) + 0.0 AS phigh, round(min(value), 7) + 0.0 AS plow, round(last(value ORDER BY ts, event_id), 7) + 0.0 AS pclose, CAST(count(*) AS DOUBLE) AS vlot FROM e GROUP BY ticker, date""",
)
def panel_events(spark, d):
    return rounded(P.derive_events(spark, d), *_PRICES[:4], digits=7).select("ticker", "date", *_PRICES[:4], "vlot")


@query("panel_next_ret", f"WITH {MONTHLY}, {RET} SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM rets")
def panel_next_ret(spark, d):
    return rounded(with_ret(monthly(spark, d)).select("ticker", "date", "ret"), "ret")


@query(
    "panel_dedupe",
    """SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2""",
)
def panel_dedupe(spark, d):
    rows = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"))
    return P.dedupe(rows, ["ticker", "date"], F.col("price"))


@query(
    "panel_upsert",
    f"""WITH {MONTHLY}, old AS (SELECT ticker, date, round(pclose, 7) AS v FROM panel WHERE date < DATE '2000-01-01'), fresh AS (SELECT ticker, date, round(popen, 7) AS v FROM panel WHERE date >= DATE '1999-06-01')
SELECT ticker, date, v + 0.0 AS v FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.ticker = old.ticker AND f.date = old.date) UNION ALL SELECT ticker, date, v + 0.0 FROM fresh""",
)
def panel_upsert(spark, d):
    p = monthly(spark, d)
    old = p.where("date < date'2000-01-01'").select("ticker", "date", F.round("pclose", 7).alias("v"))
    new = p.where("date >= date'1999-06-01'").select("ticker", "date", F.round("popen", 7).alias("v"))
    return P.upsert(old, new, ["ticker", "date"])


@query(
    "split_counts",
    f"""WITH {MONTHLY} SELECT count(*) FILTER (WHERE date < DATE '2000-01-01') AS train_rows, count(*) FILTER (WHERE date >= DATE '2000-01-01') AS test_rows, min(date) AS first_date, max(date) AS last_date FROM panel""",
)
def split_counts(spark, d):
    cut = F.lit("2000-01-01").cast("date")
    return monthly(spark, d).agg(F.count_if(F.col("date") < cut).alias("train_rows"), F.count_if(F.col("date") >= cut).alias("test_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("last_n_dates", f"WITH {MONTHLY}, days AS (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 12) SELECT ticker, date, vlot FROM panel WHERE date IN (SELECT date FROM days)")
def last_n_dates(spark, d):
    return P.last_dates(monthly(spark, d), 12).select("ticker", "date", "vlot")


@query(
    "describe_returns",
    f"""WITH {MONTHLY}, r AS (SELECT ln(pclose / lag(pclose) OVER ({TS})) AS r FROM panel) SELECT count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) AS std, round(quantile_cont(r, 0.25), 6) + 0.0 AS q25, round(quantile_cont(r, 0.5), 6) + 0.0 AS q50, round(quantile_cont(r, 0.75), 6) + 0.0 AS q75, round(skewness(r), 5) + 0.0 AS skew FROM r""",
)
def describe_returns(spark, d):
    r = evaluate(monthly(spark, d), {"r": "Delta(Log(Pclose), 1)"}, raw=True)
    n = F.count("r")
    g1 = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = r.agg(n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), q.alias("q"), g1.alias("skew"))
    a = a.select("n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), F.round("skew", 5).alias("skew"))
    return rounded(a, "mean", "std", "q25", "q50", "q75")


@query("benchmark_series", f"WITH {MONTHLY} SELECT date, round(sum(pclose * vlot) / sum(vlot), 4) AS close FROM panel GROUP BY date")
def benchmark_series(spark, d):
    return P.benchmark(monthly(spark, d)).select("date", F.round("close", 4).alias("close"))


@query(
    "panel_union_calendar",
    f"""WITH {WEEKLY}, grid AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) d)
SELECT ticker, date, round(last_value(pclose IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) + 0.0 AS pclose FROM grid LEFT JOIN panel USING (ticker, date)""",
)
def panel_union_calendar(spark, d):
    return rounded(P.dense(weekly(spark, d), ["pclose"]), "pclose", digits=7)


def _op(name: str, formula: str, sql: str, panel_cte: str = MONTHLY, derive=monthly) -> None:
    """A query of one formula's raw value beside SQL over x = ln(close), y = ln(volume), o = ln(open)."""

    def run(spark, d):
        return rounded(evaluate(derive(spark, d), {"value": formula}, raw=True).select("ticker", "date", "value"), "value")

    QUERIES[name] = run
    ORACLE[name] = f"WITH {panel_cte}, p AS (SELECT *, ln(pclose) AS x, ln(vlot) AS y, ln(popen) AS o FROM panel), v AS (SELECT ticker, date, {sql} AS value FROM p) SELECT ticker, date, round(value, 6) + 0.0 AS value FROM v"


X, Y, O = "Log(Pclose)", "Log(Vlot)", "Log(Popen)"
_SIGN = "(CASE WHEN {0} > 0 THEN 1e0 WHEN {0} < 0 THEN -1e0 ELSE 0e0 END)"
_DIFF = "(x - o)"
_op("op_abs", f"Abs(Sub({X}, {O}))", "abs(x - o)")
_op("op_sign", f"Sign(Sub({X}, {O}))", _SIGN.format(_DIFF))
_op("op_log", f"Log(Sub({X}, {O}))", "CASE WHEN x - o > 0 THEN ln(x - o) END")
_op("op_add", f"Add({X}, {Y})", "x + y")
_op("op_mul", f"Mul({X}, {Y})", "x * y")
_op("op_greater", f"Greater({X}, {Y})", "CASE WHEN x > y THEN x ELSE y END")
_op("op_less", f"Less({X}, {Y})", "CASE WHEN x < y THEN x ELSE y END")
_op("op_sub", f"Sub({X}, 0.05)", "x - 0.05")
_op("op_div", f"Div({X}, Sub({X}, {O}))", f"CASE WHEN x - o <> 0 THEN x / ({_SIGN.format(_DIFF)} * greatest(abs(x - o), 1e-6)) END")
_op("op_pow", f"Pow(Sub({X}, {O}), 0.1)", f"{_SIGN.format(_DIFF)} * pow(greatest(abs(x - o), 1e-6), 0.1)")

_W = 6
_FULL = f"count(x) {frame(_W)} = {_W}"
for _name, _fn in (("mean", "avg(x)"), ("sum", "sum(x)"), ("std", "stddev_samp(x)"), ("var", "var_samp(x)"), ("max", "max(x)"), ("min", "min(x)"), ("med", "quantile_cont(x, 0.5)"), ("skew", "skewness(x)"), ("kurt", "kurtosis(x)")):
    _op(f"op_{_name}", f"{_name.capitalize()}({X}, {_W})", f"CASE WHEN {_FULL} THEN {_fn} {frame(_W)} END")
_op("op_ref", f"Ref({X}, 3)", f"lag(x, 3) OVER ({TS})")
_op("op_delta", f"Delta({X}, 3)", f"x - lag(x, 3) OVER ({TS})")
_op("op_wma", f"WMA({X}, {_W})", f"CASE WHEN {_FULL} THEN ({' + '.join(f'{_W - i} * lag(x, {i}) OVER ({TS})' for i in range(_W))}) / {_W * (_W + 1) / 2} END")
_op("op_rank", f"Rank({X}, {_W})", f"CASE WHEN {_FULL} THEN ({' + '.join(f'(CASE WHEN lag(x, {i}) OVER ({TS}) < x THEN 1.0 ELSE 0.0 END)' for i in range(1, _W))} + (1 + {' + '.join(f'(CASE WHEN lag(x, {i}) OVER ({TS}) = x THEN 1.0 ELSE 0.0 END)' for i in range(_W))}) / 2.0) / {_W} END")
_op("op_mad", f"Mad({X}, {_W})", f"CASE WHEN {_FULL} THEN ({' + '.join(f'abs(lag(x, {i}) OVER ({TS}) - avg(x) {frame(_W)})' for i in range(_W))}) / {_W} END")
_op("op_corr", f"Corr({X}, {Y}, {_W})", f"CASE WHEN {_FULL} AND min(x) {frame(_W)} < max(x) {frame(_W)} AND min(y) {frame(_W)} < max(y) {frame(_W)} THEN covar_samp(x, y) {frame(_W)} / (stddev_samp(x) {frame(_W)} * stddev_samp(y) {frame(_W)}) END")
_op("op_cov", f"Cov({X}, {Y}, {_W})", f"CASE WHEN {_FULL} THEN covar_samp(x, y) {frame(_W)} END")

QUERIES["op_ema"] = lambda spark, d: rounded(evaluate(monthly(spark, d), {"value": f"EMA({X}, {_W})"}, raw=True).select("ticker", "date", "value"), "value")
ORACLE["op_ema"] = f"""WITH {MONTHLY}, p AS (SELECT ticker, date, ln(pclose) AS x, row_number() OVER ({TS}) AS i FROM panel)
SELECT a.ticker, a.date, CASE WHEN max(a.i) >= {_W} THEN round(sum(b.x * pow(1 - 2.0 / {_W + 1}, a.i - b.i)) / sum(pow(1 - 2.0 / {_W + 1}, a.i - b.i)), 6) + 0.0 END AS value FROM p a JOIN p b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY a.ticker, a.date"""

_CS = "(rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date)"
_op("op_csrank", f"CSRank({X})", _CS.format("x"))
_op("op_csrank_weekly", f"CSRank({X})", _CS.format("x"), WEEKLY, weekly)


def _formula(name: str, formula: str, ctes: str, value: str) -> None:
    QUERIES[name] = lambda spark, d: rounded(evaluate(monthly(spark, d), {"value": formula}).select("ticker", "date", "value"), "value", digits=9)
    ORACLE[name] = f"WITH {MONTHLY}, p AS (SELECT *, ln(pclose) AS x, ln(vlot) AS y FROM panel), {ctes} SELECT ticker, date, round(coalesce({value}, 0.0), 9) + 0.0 AS value FROM v"


_formula("formula_csrank_delta", "CSRank(Delta(Pclose, 5))", f"a AS (SELECT *, pclose - lag(pclose, 5) OVER ({TS}) AS z FROM p), v AS (SELECT *, CASE WHEN z IS NOT NULL THEN {_CS.format('z')} END AS w FROM a)", "w")
_formula("formula_mean_csrank", f"Mean(CSRank({Y}), 4)", f"a AS (SELECT *, {_CS.format('y')} AS z FROM p), v AS (SELECT *, CASE WHEN count(z) {frame(4)} = 4 THEN avg(z) {frame(4)} END AS w FROM a)", "w")
_formula("formula_shared_subtree", f"Sub(Mean({X}, 6), Mean(Mean({X}, 6), 3))", f"a AS (SELECT *, CASE WHEN {_FULL} THEN avg(x) {frame(_W)} END AS z FROM p), v AS (SELECT *, z - CASE WHEN count(z) {frame(3)} = 3 THEN avg(z) {frame(3)} END AS w FROM a)", "w")


@query(
    "op_clip_fill",
    f"""WITH {MONTHLY}, v AS (SELECT ticker, date, coalesce(ln(pclose) - lag(ln(pclose), 3) OVER ({TS}), 0.0) AS z FROM panel), q AS (SELECT quantile_cont(z, 0.005) AS lo, quantile_cont(z, 0.995) AS hi FROM v)
SELECT ticker, date, round(least(greatest(z, lo), hi), 6) + 0.0 AS value FROM v, q""",
)
def op_clip_fill(spark, d):
    return rounded(clip(evaluate(monthly(spark, d), {"value": f"Delta({X}, 3)"}), ["value"]).select("ticker", "date", "value"), "value")
