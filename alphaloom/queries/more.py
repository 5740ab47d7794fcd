"""Ingest shapes, records, catalogue views and the control plane."""

from __future__ import annotations

import random
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ic, overfit, records, regime, search, similar, simulate, tuning
from ..plans import formula as L
from ..plans.compiler import evaluate
from ..plans.formula import parse
from ..sources import catalog as C
from ..sources import panel as P
from ..sources import replay, symbols
from .common import MONTHLY, ORACLE, TS, frame, monthly, query, rounded, with_ret
from .sim import _ACT, _ADV, _regime_signals
from .stats import _FITTED, _POOL_SQL, POOL, _folds, _PROBS, pool_rows, probabilities


@query("date_chunks", "WITH b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem) SELECT CAST(s AS DATE) AS chunk_start, least(CAST(s AS DATE) + 29, hi) AS chunk_end FROM b, LATERAL (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 30 DAY)) AS s)")
def date_chunks(spark, d):
    """The span of the ship dates in chunks of 30 days."""
    low, high = P.table(spark, d, "lineitem").agg(F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))).first()
    return P.chunks(spark, str(low), str(high), 30)


@query("panel_stored", f"WITH {MONTHLY} SELECT ticker, date, round(popen, 6) AS popen, round(pclose, 6) AS pclose, vlot, round((phigh + plow + pclose) / 3, 6) AS pvwap FROM panel")
def panel_stored(spark, d):
    """A stored panel with other column names and repeated rows, read as one row per ticker and date."""
    path = f"{C.shared_folder(spark)}/panel-{uuid.uuid4().hex[:12]}"
    raw = monthly(spark, d).select(*[F.col(c).alias(c.capitalize()) for c in ("ticker", "date", "popen", "phigh", "plow", "pclose", "vlot")])
    raw.unionByName(raw.where("Ticker % 3 = 0")).write.parquet(path)
    return rounded(P.read_panel(spark, path).select("ticker", "date", "popen", "pclose", "vlot", "pvwap"), "popen", "pclose", "pvwap")


@query("split_by_share", f"WITH {MONTHLY}, c AS (SELECT min(date) + CAST(floor(round(0.7 * (max(date) - min(date)), 6)) AS INTEGER) AS cut FROM panel) SELECT any_value(cut) AS cut, count(*) FILTER (WHERE date < cut) AS train_rows, count(*) FILTER (WHERE date >= cut) AS test_rows FROM panel, c")
def split_by_share(spark, d):
    """Rows before and after the day that divides the span 70 to 30."""
    panel = monthly(spark, d)
    cut = F.lit(P.split_date(panel))
    return panel.agg(F.max(cut).alias("cut"), F.count_if(F.col("date") < cut).alias("train_rows"), F.count_if(F.col("date") >= cut).alias("test_rows"))


@query("freshness", "SELECT max(CAST(l_shipdate AS DATE)) AS last_date, date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2001-11-10') > 3 AS stale FROM lineitem")
def freshness(spark, d):
    last = F.max(F.to_date("l_shipdate"))
    return P.table(spark, d, "lineitem").agg(last.alias("last_date"), (F.date_diff(F.lit("2001-11-10").cast("date"), last) > 3).alias("stale"))


_WIDE = "w AS (SELECT l_suppkey AS ticker, l_returnflag AS item, sum(l_quantity) FILTER (WHERE month(l_shipdate) <= 3) AS q1, sum(l_quantity) FILTER (WHERE month(l_shipdate) BETWEEN 4 AND 6) AS q2, sum(l_quantity) FILTER (WHERE month(l_shipdate) > 6) AS q3 FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2)"


@query(
    "fundamentals_unpivot",
    f"""WITH {_WIDE} SELECT ticker, item, q1 AS value, DATE '1997-03-31' + 45 AS date FROM w UNION ALL SELECT ticker, item, q2, DATE '1997-06-30' + 45 FROM w UNION ALL SELECT ticker, item, q3, DATE '1997-12-31' + 45 FROM w""",
)
def fundamentals_unpivot(spark, d):
    m = F.month("l_shipdate")
    w = P.table(spark, d, "lineitem").where(F.year("l_shipdate") == 1997).groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("item"))
    w = w.agg(F.sum(F.when(m <= 3, F.col("l_quantity"))).alias("1997/3"), F.sum(F.when(m.between(4, 6), F.col("l_quantity"))).alias("1997/6"), F.sum(F.when(m > 6, F.col("l_quantity"))).alias("1997/12"))
    return P.fundamentals(w, ["1997/3", "1997/6", "1997/12"])


_MACRO = "a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders WHERE month(o_orderdate) <= 8 GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS shipped FROM lineitem WHERE month(l_shipdate) >= 5 GROUP BY 1)"


@query("macro_outer_merge", f"WITH {_MACRO} SELECT date, orders, shipped FROM a FULL JOIN b USING (date)")
def macro_outer_merge(spark, d):
    a = P.table(spark, d, "orders").where(F.month("o_orderdate") <= 8).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    b = P.table(spark, d, "lineitem").where(F.month("l_shipdate") >= 5).groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("shipped"))
    return a.join(b, "date", "full")


@query(
    "master_merge",
    f"""WITH {MONTHLY}, m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS orders FROM orders WHERE month(o_orderdate) % 3 = 0 GROUP BY 1) SELECT ticker, date, vlot, last_value(orders IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS orders FROM panel LEFT JOIN m USING (date)""",
)
def master_merge(spark, d):
    m = P.table(spark, d, "orders").where(F.month("o_orderdate") % 3 == 0).groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.count("*").alias("orders"))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return monthly(spark, d).join(F.broadcast(m), "date", "left").select("ticker", "date", "vlot", F.last("orders", ignorenulls=True).over(w).alias("orders"))


@query(
    "top_with_relaxation",
    "WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey * 4 AS score FROM supplier), e AS (SELECT max(CASE WHEN score >= 70 THEN 70 WHEN score >= 50 THEN 50 WHEN score >= 30 THEN 30 ELSE 0 END) AS edge FROM s) SELECT s_suppkey, s_acctbal, score FROM s, e WHERE score >= edge ORDER BY s_acctbal DESC, s_suppkey, score LIMIT 5",
)
def top_with_relaxation(spark, d):
    s = P.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 4).alias("score"))
    return P.top_with_relaxation(s, "score", "s_acctbal", 5)


@query(
    "regime_similarity",
    f"WITH {MONTHLY}, {_PROBS} SELECT date, round(least(1.0, greatest(0.0, (p0 * 0.2 + p1 * 0.3 + p2 * 0.5) / (sqrt(p0 * p0 + p1 * p1 + p2 * p2) * sqrt(0.38)))), 6) AS similarity FROM probs",
)
def regime_similarity(spark, d):
    return rounded(regime.cosine_to(probabilities(spark, d), [0.2, 0.3, 0.5]).select("date", "similarity"), "similarity")


_SIGMA = f"rr AS (SELECT ticker, date, ln(pclose) - lag(ln(pclose)) OVER ({TS}) AS r FROM panel), sg AS (SELECT ticker, date, CASE WHEN count(r) {frame(6)} = 6 THEN stddev_samp(r) {frame(6)} END AS sigma FROM rr)"


def _sigma(spark, d):
    return evaluate(monthly(spark, d), {"sigma": "Std(Delta(Log(Pclose), 1), 6)"}, raw=True).select("ticker", "date", "sigma")


@query(
    "forensics_snapshot",
    f"""WITH {_ACT}, {_ADV}, {_SIGMA}, pull AS (SELECT s.date, ticker, CASE formula_id WHEN 'momentum' THEN 0 WHEN 'level' THEN 1 ELSE 2 END AS regime, round(abs(signal) * CASE formula_id WHEN 'momentum' THEN p0 WHEN 'level' THEN p1 ELSE p2 END, 9) AS pull FROM s JOIN probs USING (date)),
lead_ AS (SELECT date, ticker, regime AS champion_id, row_number() OVER (PARTITION BY date, ticker ORDER BY pull DESC, regime) AS n FROM pull)
SELECT act.date, act.ticker, CASE WHEN target_weight - prev_weight > 1e-4 THEN 'BUY' WHEN target_weight - prev_weight < -1e-4 THEN 'SELL' ELSE 'HOLD' END AS action, champion_id, round(greatest(p0, p1, p2), 6) AS hmm_top_p, round(abs(target_weight - prev_weight) * 1e6 / (adv * 0.05), 6) AS adv_limit_ratio,
round(CASE WHEN sigma IS NOT NULL AND adv > 0 THEN 0.1 * sigma * sqrt(greatest(abs(target_weight - prev_weight) * 1e6 / adv, 1e-4)) * 1e4 ELSE 10.0 END, 5) AS expected_slip_bps
FROM act LEFT JOIN (SELECT * FROM lead_ WHERE n = 1) l ON l.date = act.date AND l.ticker = act.ticker LEFT JOIN probs pp ON pp.date = act.date LEFT JOIN adv a ON a.date = act.date AND a.ticker = act.ticker LEFT JOIN sg ON sg.date = act.date AND sg.ticker = act.ticker""",
)
def forensics_snapshot(spark, d):
    s = _regime_signals(spark, d)
    acted = simulate.actions(simulate.blend_raw(s, probabilities(spark, d), 5))
    out = records.snapshot(acted, s.withColumn("signal", F.round("signal", 12)), probabilities(spark, d), simulate.adv(monthly(spark, d)), _sigma(spark, d))
    return rounded(rounded(out.select("date", "ticker", "action", "champion_id", "hmm_top_p", "adv_limit_ratio", "expected_slip_bps"), "hmm_top_p", "adv_limit_ratio"), "expected_slip_bps", digits=5)


@query("rolling_refit")
def rolling_refit(spark, d):
    panel = monthly(spark, d)
    return rounded(records.refit(panel, POOL, overfit.windows(panel, 18, 12), 5, 1, limit=0.95), "ret")


@query("hall_of_fame_equity")
def hall_of_fame_equity(spark, d):
    panel = monthly(spark, d)
    return rounded(records.chained_equity(records.refit(panel, POOL, overfit.windows(panel, 18, 12), 5, 1, limit=0.95)).select("formula_id", "date", "equity", "drawdown"), "equity", "drawdown", digits=4)


@query("full_evaluation")
def full_evaluation(spark, d):
    panel = monthly(spark, d)
    out = records.full_evaluation(panel, POOL, P.benchmark(panel), 5, 1)
    return rounded(out, "ic", "rank_ic", "ir", "beta", digits=4).select("formula_id", "ic", "rank_ic", "ir", "beta", "days")


@query("rolling_forensics", f"SELECT * FROM ({{}}) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND ticker % 2 = 1".format(ORACLE["forensics_snapshot"]))
def rolling_forensics(spark, d):
    """Decision records appended to their ledger in two parts, and those of a span and of odd tickers found again."""
    path, made = f"{C.shared_folder(spark)}/records-{uuid.uuid4().hex[:12]}", C.keep(forensics_snapshot(spark, d), "made")
    for part in ("date < '1998-01-01'", "date >= '1998-01-01'"):
        C.append(made.where(part), path)
    return records.find_records(spark.read.schema(made.schema).parquet(path), "1996-01-01", "1999-12-31").where("ticker % 2 = 1")


def formula_lines(keys, years):
    """Lines as users write them: formulas, other names, comments, and what cannot be read."""
    for k, y in zip(keys, years):
        f = str(L.generate(random.Random(int(k)), 4 + int(y) % 10))
        yield {0: f, 1: f"  {f} ", 2: f"# {f}", 3: f"Unknown{f}(Pclose)", 4: f"ts_mean(close, {int(y) % 50})", 5: f"decay_linear(ts_delta(vwap, 30), {20 + int(k) % 3 * 10})"}[(int(k) + int(y)) % 6]


@query("parse_table")
def parse_table(spark, d):
    """A line for each supplier and year, read in parallel: its canonical form, size, and status or error."""
    keys = P.table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct()

    def run(batches):
        for b in batches:
            rows = []
            for line in formula_lines(b["l_suppkey"], b["y"]):
                rows += [(text, str(t) if t else None, t.size if t else None, L.status_of(t) if t else "error", e) for text, t, e in L.parse_lines(line)]
            yield pd.DataFrame(rows, columns=["text", "formula", "complexity", "status", "error"]).astype({"complexity": "Int32"})

    return keys.mapInPandas(run, "text string, formula string, complexity int, status string, error string")


@query("formula_similarity")
def formula_similarity(spark, d):
    """Pairs of similar formulas among one grown for each supplier and parts of it changed for each of its years."""
    keys = P.table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"formula": [str(L.mutate(random.Random(int(y)), L.generate(random.Random(int(k)), 12))) for k, y in zip(b["l_suppkey"], b["y"])]})

    return rounded(similar.similar_pairs(keys.mapInPandas(run, "formula string"), 0.8), "similarity")


@query(
    "replay_sample",
    f"""WITH {_POOL_SQL}, samples AS (SELECT formula_id AS ast, round(rank_ic, 6) + 0.0 AS ic, date_diff('day', DATE '1990-01-01', CAST(date AS DATE)) AS "at", CASE WHEN date < '1996-01-01' THEN 1 WHEN date < '1999-01-01' THEN 2 ELSE 4 END AS batch FROM ics WHERE rank_ic IS NOT NULL),
newest AS (SELECT * FROM samples ORDER BY batch DESC, "at" DESC, ast DESC LIMIT 150)
SELECT ast, ic, "at", batch FROM newest ORDER BY md5(concat_ws(':', '7', ast, batch, "at")) LIMIT 40""",
)
def replay_sample(spark, d):
    """Daily RankICs of the pool as samples, appended in three parts with a compaction between; 40 of the 150 newest."""
    store = replay.ReplayStore(spark, f"{C.shared_folder(spark)}/replay-{uuid.uuid4().hex[:12]}", capacity=150)
    rows = C.keep(ic.daily(pool_rows(spark, d)).where("rank_ic is not null"), "replay-rows").select(F.col("formula_id").alias("ast"), (F.round("rank_ic", 6) + F.lit(0.0)).alias("ic"), F.date_diff("date", F.lit("1990-01-01")).alias("at"), "date")
    store.append(rows.where("date < '1996-01-01'"))
    store.append(rows.where("date >= '1996-01-01' and date < '1999-01-01'"))
    store.compact()
    store.append(rows.where("date >= '1999-01-01'"))
    return store.sample(40, 7).select("ast", "ic", "at", "batch")


_BUILD = f"{MONTHLY}, big AS (SELECT ticker, count(*) AS n FROM panel GROUP BY ticker), there AS (SELECT ticker FROM big WHERE n >= 80 AND ticker % 7 <> 3)"


def _symbol_panel(spark, d):
    """Monthly bars as a file a supplier, but for some suppliers; read for all of them, 80 rows at least."""
    folder = f"{C.shared_folder(spark)}/symbols-{uuid.uuid4().hex[:12]}"
    panel = C.keep(monthly(spark, d), "panel")
    bars = panel.select(F.col("ticker").alias("symbol"), *[F.col(n).alias(c) for c, n in symbols.COLUMNS.items()])
    bars.where("symbol % 7 <> 3").repartition("symbol").write.partitionBy("symbol").option("header", True).csv(folder)
    return symbols.build_panel(spark, folder, panel.select(F.col("ticker").cast("string").alias("ticker")), least=80)


@query("symbol_panel", f"WITH {_BUILD} SELECT CAST(ticker AS VARCHAR) AS ticker, date, round(pclose, 6) AS pclose, round((phigh + plow + pclose) / 3, 6) AS ptyp FROM panel SEMI JOIN there USING (ticker)")
def symbol_panel(spark, d):
    return rounded(_symbol_panel(spark, d)[0].select("ticker", "date", "pclose", "ptyp"), "pclose", "ptyp")


@query("symbols_missing", f"WITH {_BUILD} SELECT DISTINCT CAST(ticker AS VARCHAR) AS ticker, 'empty_or_short' AS reason FROM panel ANTI JOIN there USING (ticker)")
def symbols_missing(spark, d):
    return _symbol_panel(spark, d)[1]


@query("tree_search")
def tree_search(spark, d):
    """Searches from three roots that grow together, two leaves a root and round; priors from the pool's subtrees. A round is one scoring on the panel."""
    panel = C.keep(with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose")), "panel")
    bonus = search.subtree_bonus(spark.createDataFrame([(f,) for f in POOL.values()], "formula string"))
    roots, value = [search.Root(random.Random(s), 8, leaves=2) for s in range(3)], search.PoolValues(panel)
    search.grow(roots, 3, value, bonus)
    found = [(s, str(b.tree), b.visits, b.value, value.jobs) for s, b in enumerate(r.best() for r in roots)]
    return rounded(spark.createDataFrame(found, "seed int, formula string, visits int, value double, jobs int"), "value")


@query("mined_pool")
def mined_pool(spark, d):
    """Two generations of formulas, the second bred from what the first accepted, through the Sharpe gate."""
    panel = with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose"))
    return rounded(search.sharpe_gate(search.mine(panel, 7, population=12, rounds=2), trials=24), "mean_ric", "fitness", "p")


def _names() -> str:
    return "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in POOL.items()) + ") t(formula_id, formula))"


def catalogue(spark, d) -> C.Catalog:
    """A catalogue filled from the pool's results: first what the years before 2000 gave, then the whole span; a regime's crown changes hands, one formula is taken out."""
    store = C.Catalog(spark, f"{C.shared_folder(spark)}/catalogue-{uuid.uuid4().hex[:12]}")
    names = spark.createDataFrame(list(POOL.items()), "formula_id string, formula string")
    rows = pool_rows(spark, d)
    days = ic.daily(rows)
    first = ic.summary(days.where("date < date'2000-01-01'")).join(names, "formula_id")
    store.upsert(first.select("formula", "rank_ic", F.lit("first half").alias("source"), F.lit("2000-01-01").alias("updated_at")))
    complexity = spark.createDataFrame([(k, parse(v).size) for k, v in POOL.items()], "formula_id string, complexity int")
    fitted = ic.fitness(ic.fold_ics(days, _folds(spark, d)), complexity, ic.size_corr(rows))
    wf = F.struct("mean_ric", "std_ric", F.col("pos_folds").cast("int").alias("pos_folds"), F.col("n_folds").cast("int").alias("n_folds"), F.when(F.col("status") == "ok", F.col("fitness")).alias("fitness"), F.lit(None).cast("array<double>").alias("fold_rics"), F.lit(None).cast("double").alias("size_corr"))
    whole = ic.summary(days).join(fitted.select("formula_id", wf.alias("wf"), "complexity"), "formula_id").join(names, "formula_id")
    store.upsert(whole.select("formula", "rank_ic", "wf", "complexity", F.lit("2001-01-01").alias("updated_at")))
    for state, formula_id in ((0, "trend"), (1, "level"), (0, "momentum")):
        store.crown(state, POOL[formula_id], "2001-01-15")
    store.deactivate(names.where("formula_id = 'trend'"), "2001-02-01")
    return store


#: the same records: RankIC of the whole span, fitness where the status is ok, one formula no longer live
_CATALOG = f"""{_FITTED}, {_names()}, su AS (SELECT formula_id, avg(rank_ic) AS rank_ic FROM ics GROUP BY formula_id),
cat AS (SELECT formula, formula_id, rank_ic, mean_ric, CASE WHEN status = 'ok' THEN mean_ric - 0.5 * std_ric - 0.001 * complexity - 0.5 * greatest(0.0, abs(size_corr) - 0.3) END AS fitness, complexity, CASE formula_id WHEN 'level' THEN 1 WHEN 'momentum' THEN 0 END AS champion, formula_id <> 'trend' AS live FROM f JOIN su USING (formula_id) JOIN names USING (formula_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY fitness IS NOT NULL DESC, coalesce(fitness, abs(rank_ic)) DESC, formula) AS place FROM cat)"""


@query("catalog_ranking", f"WITH {_CATALOG} SELECT formula, place FROM placed")
def catalog_ranking(spark, d):
    fit = F.col("wf.fitness")
    place = F.row_number().over(Window.orderBy(F.desc(fit.isNotNull()), F.desc(F.coalesce(fit, F.abs("rank_ic"))), "formula"))  # a catalogue is small
    return C.ranked(catalogue(spark, d).read()).select("formula", place.alias("place"))


@query("catalog_champions", f"WITH {_CATALOG}, c AS (SELECT *, row_number() OVER (PARTITION BY champion ORDER BY coalesce(fitness, rank_ic) DESC, formula) AS n FROM cat WHERE live AND champion IS NOT NULL) SELECT CAST(champion AS INTEGER) AS regime_champion_for, formula, round(coalesce(mean_ric, rank_ic), 6) + 0.0 AS mean FROM c WHERE n = 1")
def catalog_champions(spark, d):
    return rounded(C.champions(catalogue(spark, d).read()).select("regime_champion_for", "formula", "mean"), "mean")


@query("catalog_export", f"WITH {_CATALOG} SELECT formula, round(rank_ic, 6) + 0.0 AS rank_ic, round(fitness, 6) + 0.0 AS wf_fitness, CAST(complexity AS INTEGER) AS complexity, live, 'first half' AS source, CASE formula_id WHEN 'trend' THEN '2001-02-01' ELSE '2001-01-15' END AS updated_at FROM cat")
def catalog_export(spark, d):
    store = catalogue(spark, d)
    store.export(f"{store.path}/export")
    out = spark.read.option("header", True).csv(f"{store.path}/export").selectExpr("formula", "cast(rank_ic as double) rank_ic", "cast(wf_fitness as double) wf_fitness", "cast(complexity as int) complexity", "cast(live as boolean) live", "source", "updated_at")
    return rounded(out, "rank_ic", "wf_fitness")


@query("ensemble_promotion", f"WITH {_CATALOG} SELECT formula FROM cat WHERE live ORDER BY rank_ic * CASE champion WHEN 0 THEN 0.9 WHEN 1 THEN 0.1 ELSE 0.0 END DESC, formula LIMIT 1")
def ensemble_promotion(spark, d):
    return C.promote(catalogue(spark, d).read().where("live"), {0: 0.9, 1: 0.1}).select("formula")


_OLD = f"""{_FITTED}, {_names()}, su AS (SELECT formula_id, avg(ic) AS ic, avg(rank_ic) AS rank_ic FROM ics GROUP BY formula_id),
old AS (SELECT formula_id || '/' || v AS formula, rank_ic, v FROM su, range(1, 6) r(v))"""


@query("catalog_migrated", f"WITH {_OLD} SELECT formula, round(rank_ic, 6) + 0.0 AS rank_ic, round(CASE WHEN v = 1 THEN abs(rank_ic) ELSE 0.5 * rank_ic END, 6) + 0.0 AS adj_ic, CASE WHEN v < 5 THEN 1 ELSE 2 END AS ast_schema, CASE WHEN v >= 3 THEN round(rank_ic, 6) + 0.0 END AS wf_fitness, CASE WHEN v >= 4 THEN round(0.1 * rank_ic, 6) + 0.0 END AS wf_size_corr, 5 AS version, true AS live FROM old")
def catalog_migrated(spark, d):
    """The pool's results as JSON records of versions 1 to 5, each with what its version had, read into a catalogue."""
    store = C.Catalog(spark, f"{C.shared_folder(spark)}/catalogue-{uuid.uuid4().hex[:12]}")
    each = ic.summary(ic.daily(pool_rows(spark, d))).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("formula", F.concat_ws("/", "formula_id", "v"))
    since = lambda version, c: F.when(F.col("v") >= version, c)
    wf = F.struct(F.col("rank_ic").alias("fitness"), since(4, 0.1 * F.col("rank_ic")).alias("size_corr"))
    old = each.select("formula", "rank_ic", since(2, 0.5 * F.col("rank_ic")).alias("adj_ic"), since(3, wf).alias("wf"), since(5, F.lit(2)).alias("ast_schema"), since(2, F.col("v")).alias("_schema"))
    old.write.json(f"{store.path}/import")
    store.import_json(f"{store.path}/import", lines=True)
    out = store.read().select("formula", "rank_ic", "adj_ic", "ast_schema", F.col("wf.fitness").alias("wf_fitness"), F.col("wf.size_corr").alias("wf_size_corr"), F.col("_schema").alias("version"), "live")
    return rounded(out, "rank_ic", "adj_ic", "wf_fitness", "wf_size_corr")


@query("tuned_parameters")
def tuned_parameters(spark, d):
    """The six parameters of mining over their whole ranges, tuned by fifty trials on each of three overlapping windows, and their medians.

    Every trial is a search on the whole of its window's panel. Windows are three quarters of the months.
    """
    panel = C.keep(with_ret(monthly(spark, d)).withColumn("size", F.ln("pclose")), "panel")
    days = [r.date for r in panel.select("date").distinct().orderBy("date").collect()]  # a row per trading day
    found = tuning.rolling_tune(panel, days, length=len(days) * 3 // 4, probs=C.keep(probabilities(spark, d), "probs"))
    rows = [(f"window {i}", k, float(v)) for i, w in enumerate(found["windows"]) for k, v in sorted(w["params"].items())] + [("consensus", k, float(v)) for k, v in sorted(found["consensus"].items())]
    return rounded(spark.createDataFrame(rows, "span string, parameter string, value double"), "value")


_FUNDS = "p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS code, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2), r AS (SELECT date, code, price / lag(price) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM p)"


@query("fund_returns", f"""WITH {_FUNDS} SELECT date, round(max(r) FILTER (WHERE code = 'A'), 6) + 0.0 AS "A_RET", round(max(r) FILTER (WHERE code = 'N'), 6) + 0.0 AS "N_RET", round(max(r) FILTER (WHERE code = 'R'), 6) + 0.0 AS "R_RET" FROM r GROUP BY date""")
def fund_returns(spark, d):
    p = P.table(spark, d, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.col("l_returnflag").alias("code"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(P.returns_by_code(p, ["A", "N", "R"]), "A_RET", "N_RET", "R_RET")


_MASTER = f"""{MONTHLY}, {_FUNDS}, macro AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS orders FROM orders WHERE month(o_orderdate) % 3 = 0 GROUP BY 1),
funds AS (SELECT date, max(r) FILTER (WHERE code = 'A') AS a_ret, max(r) FILTER (WHERE code = 'N') AS n_ret FROM r GROUP BY date),
items AS (SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, sum(l_quantity) AS capital, sum(l_extendedprice) AS equity, sum(l_extendedprice * (l_discount - 0.05)) AS income FROM lineitem GROUP BY 1, 2),
j AS (SELECT p.ticker, p.date, pclose, orders, a_ret, n_ret, capital, equity, income FROM panel p LEFT JOIN macro USING (date) LEFT JOIN funds USING (date) LEFT JOIN items i ON i.ticker = p.ticker AND i.date = p.date),
m AS (SELECT ticker, date, pclose, {{}} FROM j)""".format(", ".join(f"last_value({c} IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("orders", "a_ret", "n_ret", "capital", "equity", "income")))


@query("master_table", f"WITH {_MASTER} SELECT ticker, date, round(pclose, 6) AS pclose, orders, round(a_ret, 6) + 0.0 AS a_ret, round(n_ret, 6) + 0.0 AS n_ret, round(pclose * capital / equity, 6) AS pd_dd, round(CASE WHEN income > 1e-6 THEN pclose * capital / income END, 2) AS fk FROM m")
def master_table(spark, d):
    """Prices with a macro series, fund returns and quarterly fundamentals, carried forward, and their ratios."""
    lines = P.table(spark, d, "lineitem")
    macro = P.table(spark, d, "orders").where(F.month("o_orderdate") % 3 == 0).groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.count("*").alias("orders"))
    p = lines.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.col("l_returnflag").alias("code"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    funds = P.returns_by_code(p, ["A", "N"]).select("date", F.col("A_RET").alias("a_ret"), F.col("N_RET").alias("n_ret"))
    income = F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    items = lines.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("capital"), F.sum("l_extendedprice").alias("equity"), F.when(F.abs(income) > 1e-6, income).otherwise(0.0).alias("income"))
    out = P.master(monthly(spark, d).select("ticker", "date", "pclose"), macro, funds, items)
    return rounded(rounded(out, "pclose", "a_ret", "n_ret", "pd_dd"), "fk", digits=2)


@query("unused_returns", f"WITH {MONTHLY}, r AS (SELECT ticker, date, lead(pclose, 2) OVER ({TS}) / lead(pclose, 1) OVER ({TS}) - 1 AS ret FROM panel) SELECT ticker, count(*) AS missing FROM r WHERE ret IS NULL GROUP BY ticker")
def unused_returns(spark, d):
    return with_ret(monthly(spark, d)).where("ret is null").groupBy("ticker").agg(F.count("*").alias("missing"))
