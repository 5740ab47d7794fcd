"""Information coefficients, neutralisation, fitness, regimes, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chain, ic, regime
from ..plans.compiler import clip, evaluate, signals
from ..plans.formula import parse
from ..sources import panel as P
from ..sources.catalog import keep
from .common import MONTHLY, RET, TS, WEEKLY, frame, monthly, query, rounded, weekly, with_ret

POOL = {"momentum": "CSRank(Delta(Pclose, 5))", "level": "CSRank(Log(Vlot))", "trend": "Sub(Log(Pclose), Mean(Log(Pclose), 6))"}

_AVG = "(rank() OVER (PARTITION BY {0} ORDER BY {1} NULLS LAST) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0)"
_PCT = "CASE WHEN {0} IS NOT NULL THEN " + _AVG.format("date", "{0}") + " / count({0}) OVER (PARTITION BY date) END"
_SAFE = "covar_samp({0}, {1}) / nullif(stddev_samp({0}) * stddev_samp({1}), 0)"
_IC = "CASE WHEN count(*) < 2 THEN NULL WHEN min({0}) = max({0}) THEN 0.0 WHEN min({1}) = max({1}) THEN NULL ELSE " + _SAFE + " END"

_CLIP = "{0} AS (SELECT {1}.* REPLACE (least(greatest(signal, lo), hi) AS signal) FROM {1} JOIN (SELECT {2}, quantile_cont(signal, 0.005) AS lo, quantile_cont(signal, 0.995) AS hi FROM {1} GROUP BY {2}) USING ({2}))"
_STACK = f"""s0 AS (SELECT 'momentum' AS formula_id, ticker, date, coalesce(momentum, 0.0) AS signal, ret, lx AS size FROM b UNION ALL SELECT 'level', ticker, date, coalesce(level, 0.0), ret, lx FROM b UNION ALL SELECT 'trend', ticker, date, coalesce(trend, 0.0), ret, lx FROM b),
{_CLIP.format('s', 's0', 'formula_id')}"""

#: the pool's signals: missing values 0, clipped at each formula's 0.5 % and 99.5 % quantiles, stacked
_POOL_SQL = f"""{MONTHLY}, {RET},
b AS (SELECT *, {_PCT.format('d5')} AS momentum, {_PCT.format('lv')} AS level, lx - CASE WHEN count(lx) {frame(6)} = 6 THEN avg(lx) {frame(6)} END AS trend FROM rets),
{_STACK},
there AS (SELECT * FROM s WHERE ret IS NOT NULL),
ranked AS (SELECT *, {_AVG.format('formula_id, date', 'signal')} AS rs, {_AVG.format('formula_id, date', 'ret')} AS ry FROM there),
ics AS (SELECT formula_id, date, {_IC.format('signal', 'ret')} AS ic, {_IC.format('rs', 'ry')} AS rank_ic, count(*) AS n FROM ranked GROUP BY formula_id, date)"""


def pool_rows(spark, d):
    panel = with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose"))
    return signals(panel, POOL, "ret", "size")


@query("ic_daily", f"WITH {_POOL_SQL} SELECT formula_id, date, round(ic, 6) + 0.0 AS ic, n FROM ics")
def ic_daily(spark, d):
    return rounded(ic.daily(pool_rows(spark, d)).select("formula_id", "date", "ic", "n"), "ic")


@query("rank_ic_daily", f"WITH {_POOL_SQL} SELECT formula_id, date, round(rank_ic, 6) + 0.0 AS rank_ic, n FROM ics")
def rank_ic_daily(spark, d):
    return rounded(ic.daily(pool_rows(spark, d)).select("formula_id", "date", "rank_ic", "n"), "rank_ic")


@query("ic_summary", f"WITH {_POOL_SQL} SELECT formula_id, round(avg(ic), 6) + 0.0 AS ic, round(avg(rank_ic), 6) + 0.0 AS rank_ic, round(stddev_samp(rank_ic), 6) AS rank_ic_std, count(rank_ic) AS days FROM ics GROUP BY formula_id")
def ic_summary(spark, d):
    return rounded(ic.summary(ic.daily(pool_rows(spark, d))), "ic", "rank_ic", "rank_ic_std")


@query(
    "pooled_rank_ic",
    f"WITH {_POOL_SQL}, r AS (SELECT *, {_AVG.format('formula_id', 'signal')} AS a, {_AVG.format('formula_id', 'ret')} AS b FROM there) SELECT formula_id, round({_IC.format('a', 'b')}, 6) + 0.0 AS rank_ic, count(*) AS n FROM r GROUP BY formula_id",
)
def pooled_rank_ic(spark, d):
    return rounded(ic.pooled_rank_ic(pool_rows(spark, d)), "rank_ic")


_FACTORS = f"""{MONTHLY}, r0 AS (SELECT *, pclose / lag(pclose) OVER ({TS}) - 1 AS r FROM panel),
factors AS (SELECT ticker, date, pclose, ln(greatest(pclose, 1e-6)) AS size, CASE WHEN count(r) {frame(20)} >= 5 THEN stddev_samp(r) {frame(20)} END AS vol, pclose / lag(pclose, 20) OVER ({TS}) - 1 AS mom FROM r0)"""
_ORD = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN count({0}) OVER (PARTITION BY date) < 2 THEN 0.0 ELSE (row_number() OVER (PARTITION BY date ORDER BY {0} NULLS LAST, ticker) - 1) / CAST(count({0}) OVER (PARTITION BY date) - 1 AS DOUBLE) - 0.5 END END"


@query("factor_build", f"WITH {_FACTORS} SELECT ticker, date, round(size, 6) + 0.0 AS size, round(vol, 6) + 0.0 AS vol, round(mom, 6) + 0.0 AS mom FROM factors")
def factor_build(spark, d):
    return rounded(ic.factors(monthly(spark, d)).select("ticker", "date", "size", "vol", "mom"), "size", "vol", "mom")


@query("factor_rank_norm", f"WITH {_FACTORS} SELECT ticker, date, round({_ORD.format('size')}, 6) + 0.0 AS size_rank, round({_ORD.format('vol')}, 6) + 0.0 AS vol_rank, round({_ORD.format('mom')}, 6) + 0.0 AS mom_rank FROM factors")
def factor_rank_norm(spark, d):
    names = ("size_rank", "vol_rank", "mom_rank")
    return rounded(ic.factor_ranks(ic.factors(monthly(spark, d))).select("ticker", "date", *names), *names)


@query(
    "size_corr",
    f"""WITH {_POOL_SQL}, sr AS (SELECT *, {_AVG.format('formula_id, date', 'signal')} AS a, {_AVG.format('formula_id, date', 'size')} AS b FROM s), days AS (SELECT formula_id, date, CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) END AS c FROM sr GROUP BY formula_id, date)
SELECT formula_id, round(coalesce(avg(c), 0.0), 6) + 0.0 AS size_corr FROM days GROUP BY formula_id""",
)
def size_corr(spark, d):
    return rounded(ic.size_corr(pool_rows(spark, d)), "size_corr")


@query(
    "size_bin_demean",
    f"""WITH {_POOL_SQL}, o AS (SELECT formula_id, ticker, date, signal, row_number() OVER (PARTITION BY formula_id, date ORDER BY size, ticker) - 1 AS i, count(*) OVER (PARTITION BY formula_id, date) AS n FROM s WHERE size IS NOT NULL),
g AS (SELECT *, greatest(ceil(i * least(10, greatest(2, floor(n / 5.0))) / greatest(n - 1, 1)) - 1, 0) AS bin FROM o)
SELECT formula_id, ticker, date, CAST(bin AS BIGINT) AS bin, round(CASE WHEN count(*) OVER b >= 2 THEN signal - avg(signal) OVER b ELSE signal END, 6) + 0.0 AS demeaned FROM g WINDOW b AS (PARTITION BY formula_id, date, bin)""",
)
def size_bin_demean(spark, d):
    return rounded(ic.demean_by_size(pool_rows(spark, d)).select("formula_id", "ticker", "date", F.col("bin").cast("bigint").alias("bin"), "demeaned"), "demeaned")


@query(
    "neutralize_size",
    f"""WITH {_POOL_SQL}, m AS (SELECT formula_id, ticker, date, signal, size, count(*) OVER w AS n, avg(signal) OVER w AS ms, avg(size) OVER w AS mz, covar_pop(signal, size) OVER w AS c, var_pop(size) OVER w AS v FROM s WHERE size IS NOT NULL WINDOW w AS (PARTITION BY formula_id, date))
SELECT formula_id, ticker, date, round(CASE WHEN n >= 5 THEN signal - ms - coalesce(c / nullif(v, 0), 0) * (size - mz) ELSE signal END, 6) + 0.0 AS residual FROM m""",
)
def neutralize_size(spark, d):
    return rounded(ic.residual_one(pool_rows(spark, d), "signal", "size", "residual", least=5).select("formula_id", "ticker", "date", "residual"), "residual")


_DAY = "(PARTITION BY formula_id, date)"
_PROJ = "coalesce(CASE WHEN sum({1} * {1}) OVER w > 1e-12 THEN sum({0} * {1}) OVER w / sum({1} * {1}) OVER w END, 0.0) * {1}"
#: the signal's rank less its projection on three factor ranks, made orthogonal one after another; then size bins
_NEUTRAL = f"""{_POOL_SQL}, r0 AS (SELECT *, pclose / lag(pclose) OVER ({TS}) - 1 AS r FROM panel),
factors AS (SELECT ticker, date, ln(greatest(pclose, 1e-6)) AS size, CASE WHEN count(r) {frame(20)} >= 5 THEN stddev_samp(r) {frame(20)} END AS vol, pclose / lag(pclose, 20) OVER ({TS}) - 1 AS mom FROM r0),
fr AS (SELECT ticker, date, {_ORD.format('size')} AS f1, {_ORD.format('vol')} AS f2, {_ORD.format('mom')} AS f3 FROM factors),
n0 AS (SELECT formula_id, s.ticker, s.date, signal, f1, f2, f3, count(*) OVER {_DAY.replace('formula_id, date', 'formula_id, s.date')} AS n, (row_number() OVER (PARTITION BY formula_id, s.date ORDER BY signal, s.ticker) - 1) / greatest(1, count(signal) OVER (PARTITION BY formula_id, s.date) - 1) - 0.5 AS y FROM s JOIN fr USING (ticker, date)),
n1 AS (SELECT *, f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AS fine FROM n0),
n2 AS (SELECT *, count(*) FILTER (WHERE fine) OVER w AS m, CASE WHEN fine THEN y - avg(y) FILTER (WHERE fine) OVER w END AS y0, CASE WHEN fine THEN f1 - avg(f1) FILTER (WHERE fine) OVER w END AS a0, CASE WHEN fine THEN f2 - avg(f2) FILTER (WHERE fine) OVER w END AS b0, CASE WHEN fine THEN f3 - avg(f3) FILTER (WHERE fine) OVER w END AS c0 FROM n1 WINDOW w AS {_DAY}),
n3 AS (SELECT *, y0 - {_PROJ.format('y0', 'a0')} AS y1, b0 - {_PROJ.format('b0', 'a0')} AS b1, c0 - {_PROJ.format('c0', 'a0')} AS c1 FROM n2 WINDOW w AS {_DAY}),
n4 AS (SELECT *, y1 - {_PROJ.format('y1', 'b1')} AS y2, c1 - {_PROJ.format('c1', 'b1')} AS c2 FROM n3 WINDOW w AS {_DAY}),
n5 AS (SELECT *, CASE WHEN m >= 10 THEN y2 - {_PROJ.format('y2', 'c2')} ELSE signal END AS res FROM n4 WINDOW w AS {_DAY}),
n6 AS (SELECT *, res IS NOT NULL AND f1 IS NOT NULL AS there, row_number() OVER (PARTITION BY formula_id, date ORDER BY CASE WHEN res IS NOT NULL THEN f1 END NULLS LAST, ticker) - 1 AS i, count(*) FILTER (WHERE res IS NOT NULL AND f1 IS NOT NULL) OVER {_DAY} AS n2 FROM n5),
n7 AS (SELECT *, CASE WHEN there THEN greatest(ceil(i * least(10, greatest(2, floor(n2 / 5.0))) / greatest(n2 - 1, 1)) - 1, 0) END AS bin FROM n6)
SELECT formula_id, ticker, date, round(CASE WHEN n < 10 THEN signal WHEN there AND n2 >= 2 AND count(*) OVER b >= 2 THEN res - avg(res) OVER b ELSE res END, 6) + 0.0 AS neutral FROM n7 WINDOW b AS (PARTITION BY formula_id, date, bin)"""


@query("neutralize_factors", f"WITH {_NEUTRAL}")
def neutralize_factors(spark, d):
    panel = ic.factor_ranks(ic.factors(monthly(spark, d)))
    rows = signals(panel, POOL, "size_rank", "vol_rank", "mom_rank")
    return rounded(ic.neutralize(rows, ["size_rank", "vol_rank", "mom_rank"]), "neutral")


def _folds(spark, d, n=4, embargo=1, least=10, rows=None):
    """Folds of the panel's dates, taken from ``rows`` where they are at hand."""
    days = sorted(r.date for r in (monthly(spark, d) if rows is None else rows).select("date").distinct().collect())
    return ic.fold_table(spark, ic.folds(days, n, embargo, least))


_FOLDS = f"""days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
folds AS (SELECT k AS fold, date FROM days, range(4) AS t(k) WHERE i >= floor(n * k / 4.0) + 1 AND i < floor(n * (k + 1) / 4.0) - 1)"""


@query("wf_folds", f"WITH {MONTHLY}, {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, date FROM folds")
def wf_folds(spark, d):
    return _folds(spark, d)


_FOLD_RIC = f"{_POOL_SQL}, {_FOLDS}, ric AS (SELECT formula_id, fold, avg(rank_ic) AS ric, sum(n) AS nrows FROM ics JOIN folds USING (date) GROUP BY formula_id, fold HAVING sum(n) >= 20)"


@query("wf_fold_ric", f"WITH {_FOLD_RIC} SELECT formula_id, CAST(fold AS INTEGER) AS fold, round(ric, 6) + 0.0 AS ric, CAST(nrows AS BIGINT) AS n_rows FROM ric")
def wf_fold_ric(spark, d):
    rows = pool_rows(spark, d)
    return rounded(ic.fold_ics(ic.daily(rows), _folds(spark, d, rows=rows)), "ric").withColumnRenamed("rows", "n_rows")


_SIZES = {k: parse(v).size for k, v in POOL.items()}
_FITTED = f"""{_FOLD_RIC}, sr AS (SELECT *, {_AVG.format('formula_id, date', 'signal')} AS a, {_AVG.format('formula_id, date', 'size')} AS b FROM s),
sc AS (SELECT formula_id, coalesce(avg(c), 0.0) AS size_corr FROM (SELECT formula_id, date, CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) END AS c FROM sr GROUP BY formula_id, date) GROUP BY formula_id),
per AS (SELECT formula_id, avg(ric) AS mean_ric, stddev_pop(ric) AS std_ric, count(*) FILTER (WHERE ric > 0) AS pos_folds, count(*) AS n_folds FROM ric WHERE ric IS NOT NULL GROUP BY formula_id),
cx AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _SIZES.items())}) t(formula_id, complexity)),
f AS (SELECT *, CASE WHEN abs(size_corr) > 0.95 THEN 'size_factor' WHEN coalesce(n_folds, 0) < 2 THEN 'insufficient' ELSE 'ok' END AS status FROM cx LEFT JOIN sc USING (formula_id) LEFT JOIN per USING (formula_id))"""
_FIT = f"""WITH {_FITTED} SELECT formula_id, status, round(mean_ric, 6) + 0.0 AS mean_ric, round(CASE WHEN status = 'ok' THEN mean_ric - 0.5 * std_ric - 0.001 * complexity - 0.5 * greatest(0.0, abs(size_corr) - 0.3) ELSE -1e9 END, 6) AS fitness, pos_folds, n_folds,
CASE WHEN status = 'size_factor' THEN 'Size-Factor' WHEN coalesce(n_folds, 0) = 0 THEN '—' WHEN pos_folds / CAST(n_folds AS DOUBLE) >= 0.8 AND mean_ric >= 0.005 THEN 'Stable' WHEN pos_folds / CAST(n_folds AS DOUBLE) >= 0.6 AND mean_ric > 0 THEN 'Unstable' WHEN mean_ric <= 0 OR pos_folds / CAST(n_folds AS DOUBLE) < 0.4 THEN 'Invalid' ELSE 'Overfit' END AS verdict FROM f"""


@query("wf_fitness", _FIT)
def wf_fitness(spark, d):
    rows = pool_rows(spark, d)
    cx = spark.createDataFrame(list(_SIZES.items()), "formula_id string, complexity int")
    out = ic.fitness(ic.fold_ics(ic.daily(rows), _folds(spark, d, rows=rows)), cx, ic.size_corr(rows))
    return rounded(out.select("formula_id", "status", "mean_ric", "fitness", "pos_folds", "n_folds", "verdict"), "mean_ric", "fitness")


#: weeks start on Mondays, so ten business days before one are fourteen days
_PURGED = """days0 AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)), edges AS (SELECT CAST(k AS INTEGER) AS fold, floor(n * k / 5.0) + 2 AS a, floor(n * (k + 1) / 5.0) - 2 AS b FROM range(5) t(k), (SELECT max(n) AS n FROM days0)), cut AS (SELECT fold, a, b, (SELECT date FROM days0 WHERE i = a) AS first_test, (SELECT date FROM days0 WHERE i = b - 1) AS last_test FROM edges WHERE b - a >= 10)
SELECT fold, 'test' AS role, date FROM cut JOIN days0 ON i >= a AND i < b UNION ALL SELECT fold, 'train', date FROM cut JOIN days0 ON date <= first_test - INTERVAL 14 DAY OR date > last_test"""


@query("purged_folds", f"WITH {WEEKLY}, {_PURGED}")
def purged_folds(spark, d):
    days = sorted(r.date for r in weekly(spark, d).select("date").distinct().collect())
    rows = [(f["fold"], role, x) for f in ic.purged_folds(days, 5, 10, 2, 10) for role in ("test", "train") for x in f[role]]
    return spark.createDataFrame(rows, "fold int, role string, date date")


_BENCH = "bench AS (SELECT date, sum(pclose * vlot) / sum(vlot) AS close FROM panel GROUP BY date)"
_REGIME = f"""{_BENCH}, br AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench),
bt AS (SELECT date, close / lag(close, 12) OVER (ORDER BY date) - 1 AS t, CASE WHEN count(r) OVER v = 6 THEN stddev_samp(r) OVER v END AS v FROM br WINDOW v AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
regimes AS (SELECT date, CASE WHEN t > 0 AND v < 0.2 THEN 'bull' WHEN t < 0 AND v >= 0.2 THEN 'bear' ELSE 'chop' END AS regime FROM bt)"""


def regimes(spark, d):
    return regime.rule_regime(P.benchmark(monthly(spark, d)), 12, 6, 0.2)


@query("regime_labels", f"WITH {MONTHLY}, {_REGIME} SELECT date, regime FROM regimes")
def regime_labels(spark, d):
    return regimes(spark, d)


@query(
    "regime_ic_breakdown",
    f"""WITH {_POOL_SQL}, {_REGIME}, j AS (SELECT t.*, coalesce(g.regime, 'chop') AS regime FROM there t LEFT JOIN regimes g USING (date)),
k AS (SELECT *, {_AVG.format('formula_id, regime, date', 'signal')} AS a, {_AVG.format('formula_id, regime, date', 'ret')} AS b FROM j),
dd AS (SELECT formula_id, regime, date, CASE WHEN count(*) >= 5 AND min(a) < max(a) THEN {_IC.format('a', 'b')} END AS ic FROM k GROUP BY formula_id, regime, date)
SELECT formula_id, regime, round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS days FROM dd GROUP BY formula_id, regime""",
)
def regime_ic_breakdown(spark, d):
    return rounded(regime.breakdown(regime.attach(pool_rows(spark, d), regimes(spark, d))), "mean_ic")


#: probabilities of three regimes as a function of the month, for weights and blends
_PROBS = "probs AS (SELECT date, (month(date) % 3 + 1) / 6.0 AS p0, (month(date) % 2 + 1) / 6.0 AS p1, 1 - (month(date) % 3 + 1) / 6.0 - (month(date) % 2 + 1) / 6.0 AS p2 FROM (SELECT DISTINCT date FROM panel))"


def probabilities(spark, d):
    m = F.month("date")
    p0, p1 = (m % 3 + 1) / 6.0, (m % 2 + 1) / 6.0
    return monthly(spark, d).select("date").distinct().select("date", F.array(p0, p1, 1 - p0 - p1).alias("p"))


_WEIGHTS = f"""{_PROBS}, ref AS (SELECT * FROM probs ORDER BY date DESC LIMIT 1),
weights AS (SELECT p.date, 0.1 + 0.9 * exp(5.0 * (least(1.0, greatest(0.0, (p.p0 * r.p0 + p.p1 * r.p1 + p.p2 * r.p2) / (sqrt(p.p0 * p.p0 + p.p1 * p.p1 + p.p2 * p.p2) * sqrt(r.p0 * r.p0 + r.p1 * r.p1 + r.p2 * r.p2)))) - 1)) AS weight FROM probs p, ref r)"""


@query("regime_weights", f"WITH {MONTHLY}, {_WEIGHTS} SELECT date, round(weight, 6) AS weight FROM weights")
def regime_weights(spark, d):
    return rounded(regime.regime_weights(probabilities(spark, d)), "weight")


@query("weighted_ric", f"WITH {_POOL_SQL}, {_FOLDS}, {_WEIGHTS} SELECT formula_id, CAST(fold AS INTEGER) AS fold, round(sum(weight * rank_ic) / sum(weight), 6) + 0.0 AS ric, CAST(sum(n) AS BIGINT) AS n_rows FROM ics JOIN folds USING (date) JOIN weights USING (date) WHERE rank_ic IS NOT NULL GROUP BY formula_id, fold HAVING sum(n) >= 20")
def weighted_ric(spark, d):
    w = regime.regime_weights(probabilities(spark, d))
    return rounded(ic.fold_ics(ic.daily(pool_rows(spark, d)), _folds(spark, d), weights=w), "ric").withColumnRenamed("rows", "n_rows")


_AHEAD = [f"lead(pclose, {k}) OVER ({TS})" for k in range(1, 6)]
_TB = f"""{MONTHLY}, r0 AS (SELECT *, pclose / lag(pclose) OVER ({TS}) - 1 AS r, row_number() OVER ({TS}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM panel),
r1 AS (SELECT *, CASE WHEN count(r) {frame(10)} = 10 THEN greatest(stddev_samp(r) {frame(10)}, 0.005) END AS sigma FROM r0 WHERE n >= 20),
r2 AS (SELECT *, pclose * (1 + 1.0 * sigma) AS hi, pclose * (1 - 1.0 * sigma) AS lo, {', '.join(f'{a} AS n{k}' for k, a in enumerate(_AHEAD, 1))} FROM r1),
r3 AS (SELECT *, CASE {' '.join(f'WHEN n{k} >= hi THEN {k}' for k in range(1, 6))} ELSE 0 END AS a, CASE {' '.join(f'WHEN n{k} <= lo THEN {k}' for k in range(1, 6))} ELSE 0 END AS b FROM r2),
tb AS (SELECT ticker, date, CASE WHEN i >= 10 AND i < n - 5 AND sigma IS NOT NULL THEN CASE WHEN a > 0 AND (b = 0 OR a <= b) THEN 1e0 WHEN b > 0 THEN -1e0 ELSE 0e0 END ELSE 0e0 END AS label, CASE WHEN i >= 10 AND i < n - 5 AND sigma IS NOT NULL THEN 1e0 ELSE 0e0 END AS weight FROM r3)"""


def barrier(spark, d):
    return regime.triple_barrier(monthly(spark, d), 5, 1.0, 1.0, 10)


@query("triple_barrier_labels", f"WITH {_TB} SELECT ticker, date, label, weight FROM tb")
def triple_barrier_labels(spark, d):
    return barrier(spark, d)


@query("label_stats", f"WITH {_TB} SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM tb GROUP BY label")
def label_stats(spark, d):
    return rounded(regime.label_shares(barrier(spark, d)), "share")


def meta_rows(spark, d):
    panel = ic.factor_ranks(ic.factors(with_ret(monthly(spark, d))))
    rows = clip(evaluate(panel, {"signal": POOL["trend"]}), ["signal"])
    tb = barrier(spark, d).select("ticker", "date", F.col("label").alias("tb_label"))
    return regime.meta_dataset(regime.attach(rows.join(tb, ["ticker", "date"], "left"), regimes(spark, d)))


@query(
    "meta_features",
    f"""WITH {_TB}, {RET}, {_REGIME}, b0 AS (SELECT 0 AS one, ticker, date, ret, coalesce(lx - CASE WHEN count(lx) {frame(6)} = 6 THEN avg(lx) {frame(6)} END, 0.0) AS signal FROM rets), {_CLIP.format('b', 'b0', 'one')},
k AS (SELECT date, {_AVG.format('date', 'signal')} AS rs, {_AVG.format('date', 'ret')} AS ry FROM b WHERE ret IS NOT NULL),
ics AS (SELECT date, {_IC.format('rs', 'ry')} AS ic FROM k GROUP BY date),
rec AS (SELECT date, CASE WHEN count(ic) OVER v >= 5 THEN avg(ic) OVER v END AS recent_ic FROM ics WINDOW v AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT b.ticker, b.date, round({_PCT.format('signal')}, 6) AS sig_rank, round(recent_ic, 6) + 0.0 AS recent_ic, CASE WHEN coalesce(g.regime, 'chop') = 'bull' THEN 1 ELSE 0 END AS is_bull,
CASE WHEN coalesce(tb.label > 0, false) OR (tb.label IS NULL AND coalesce(ret >= 0, false)) THEN 1 ELSE 0 END AS label FROM b LEFT JOIN rec USING (date) LEFT JOIN regimes g USING (date) LEFT JOIN tb ON tb.ticker = b.ticker AND tb.date = b.date""".replace("PARTITION BY date ORDER BY signal", "PARTITION BY b.date ORDER BY signal").replace("PARTITION BY date, signal", "PARTITION BY b.date, signal").replace("count(signal) OVER (PARTITION BY date)", "count(signal) OVER (PARTITION BY b.date)").replace("k AS (SELECT date, (rank() OVER (PARTITION BY b.date ORDER BY signal NULLS LAST) + (count(*) OVER (PARTITION BY b.date, signal)", "k AS (SELECT date, (rank() OVER (PARTITION BY date ORDER BY signal NULLS LAST) + (count(*) OVER (PARTITION BY date, signal)"),
)
def meta_features(spark, d):
    return rounded(meta_rows(spark, d).select("ticker", "date", "sig_rank", "recent_ic", "is_bull", "label"), "sig_rank", "recent_ic")


@query("meta_model_scores")
def meta_model_scores(spark, d):
    data = keep(meta_rows(spark, d), "meta")
    model, _ = regime.train_meta(data, "2000-01-01")
    return rounded(regime.predict_meta(model, data).select("ticker", "date", "p"), "p", digits=4)


_HMM = f"""{MONTHLY}, h0 AS (SELECT *, lag(pclose) OVER ({TS}) AS prev FROM panel), h1 AS (SELECT *, ln(pclose / prev) AS log_ret, CASE WHEN prev IS NULL THEN phigh - plow ELSE greatest(phigh - plow, abs(phigh - prev), abs(plow - prev)) END AS tr FROM h0),
h2 AS (SELECT ticker, date, log_ret, CASE WHEN count(tr) {frame(14)} = 14 THEN avg(tr) {frame(14)} / pclose END AS atr, CASE WHEN count(vlot) {frame(20)} = 20 THEN vlot / avg(vlot) {frame(20)} END AS vol_ratio, (phigh - plow) / pclose AS hl FROM h1)"""


@query("hmm_features", f"WITH {_HMM} SELECT ticker, date, round(log_ret, 6) + 0.0 AS log_ret, round(atr, 5) + 0.0 AS atr, round(vol_ratio, 6) AS vol_ratio, round(hl, 5) + 0.0 AS hl FROM h2 WHERE log_ret IS NOT NULL AND atr IS NOT NULL AND vol_ratio IS NOT NULL AND hl IS NOT NULL")
def hmm_features(spark, d):
    return rounded(rounded(regime.hmm_features(monthly(spark, d)), "log_ret", "vol_ratio"), "atr", "hl", digits=5)


#: A three-state model of monthly (log return, log of high over low), given, not fitted.
CHAIN = {"k": 3, "pi": [0.5, 0.3, 0.2], "a": [[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.15, 0.25, 0.6]], "m": [[0.0, 2.0], [0.5, 3.5], [-0.5, 5.0]], "s": [[2.0, 1.5], [3.0, 1.5], [5.0, 2.0]]}


def _chain_sql(model: dict) -> str:
    """Forward and backward recursion, date by date, over every ticker."""
    k = range(model["k"])
    emit = ", ".join("exp(-0.5 * (" + " + ".join(f"power({x} - ({m}), 2) / {v} + ln({v})" for x, m, v in zip(("log_ret", "hl"), model["m"][j], model["s"][j])) + f")) AS b{j}" for j in k)
    a = model["a"]
    into = ", ".join("(" + " + ".join(f"f.f{i} * {a[i][j]}" for i in k) + f") * e.b{j} AS u{j}" for j in k)
    back = ", ".join(" + ".join(f"{a[i][j]} * e.b{j} * g.g{j}" for j in k) + f" AS u{i}" for i in k)
    norm = lambda name: ", ".join(f"u{j} / (" + " + ".join(f"u{i}" for i in k) + f") AS {name}{j}" for j in k)
    begin = ", ".join(f"{model['pi'][j]} * b{j} AS u{j}" for j in k)
    total = " + ".join(f"f{j} * g{j}" for j in k)
    out = ", ".join([*(f"round(f{j}, 6) + 0.0 AS filtered_{j}" for j in k), *(f"round(f{j} * g{j} / ({total}), 6) + 0.0 AS smoothed_{j}" for j in k)])
    return f"""WITH RECURSIVE {MONTHLY}, x AS (SELECT ticker, date, ln(pclose / lag(pclose) OVER ({TS})) AS log_ret, ln(phigh / plow) AS hl FROM panel),
e AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, count(*) OVER (PARTITION BY ticker) AS last, {emit} FROM x WHERE log_ret IS NOT NULL),
f AS (SELECT ticker, n, {norm('f')} FROM (SELECT ticker, n, {begin} FROM e WHERE n = 1) UNION ALL SELECT ticker, n, {norm('f')} FROM (SELECT e.ticker, e.n, {into} FROM f JOIN e ON e.ticker = f.ticker AND e.n = f.n + 1)),
g AS (SELECT ticker, n, {', '.join(f'1.0::DOUBLE AS g{j}' for j in k)} FROM e WHERE n = last UNION ALL SELECT ticker, n, {norm('g')} FROM (SELECT g.ticker, g.n - 1 AS n, {back} FROM g JOIN e ON e.ticker = g.ticker AND e.n = g.n WHERE g.n > 1))
SELECT e.ticker, e.date, {out} FROM e JOIN f USING (ticker, n) JOIN g USING (ticker, n)"""


@query("chain_probs", _chain_sql(CHAIN))
def chain_probs(spark, d):
    """Filtered and smoothed state probabilities of every ticker under a given model; chunks of half a year, so that carries go through several levels."""
    x = monthly(spark, d).select("ticker", "date", F.ln(F.try_divide("pclose", F.lag("pclose").over(Window.partitionBy("ticker").orderBy("date")))).alias("log_ret"), F.ln(F.try_divide("phigh", "plow")).alias("hl"))
    out = chain.probabilities(x, ["log_ret", "hl"], CHAIN, days=183, width=4)
    each = [(f"{n}_{j}", F.round(F.get(n, j), 6) + F.lit(0.0)) for n in ("filtered", "smoothed") for j in range(3)]
    return out.select("ticker", "date", *[c.alias(n) for n, c in each])


CHAIN_NAMES = ["log_ret", "atr", "vol_ratio", "hl"]


@query("hmm_filtered_probs")
def hmm_filtered_probs(spark, d):
    """A model of two or three states fitted over all tickers at once; causal probabilities of every complete row."""
    scaled = regime.robust_scale(keep(regime.hmm_features(monthly(spark, d)), "hmm"), CHAIN_NAMES)
    made = chain.cut(scaled, CHAIN_NAMES)
    model = chain.select(scaled, CHAIN_NAMES, (2, 3), least=20, rounds=8, made=made)
    return chain.probabilities(scaled, CHAIN_NAMES, model, made=made).select("ticker", "date", F.col("filtered").alias("p"))


@query("signal_pool", f"WITH {_POOL_SQL} SELECT formula_id, ticker, date, round(signal, 6) + 0.0 AS signal FROM s")
def signal_pool(spark, d):
    return rounded(signals(monthly(spark, d), POOL), "signal")

