"""Path-dependent queries against plain Python, stores, and published values of the synthetic market."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom import registry
from alphaloom.operators import chain, ic, overfit, regime, simulate
from alphaloom.plans import compiler
from alphaloom.plans.formula import parse
from alphaloom.queries import common, stats
from alphaloom.sources import catalog, panel
from alphaloom.sources.config import MiningSettings


def topk(days, k, drop, buy=0.0005, sell=0.0015):
    """``days``: date -> {ticker: (signal, ret, slip)}; the daily returns of the portfolio."""
    held, out = [], {}
    for date in sorted(days):
        day = days[date]
        best = sorted((t for t in day if day[t][0] is not None), key=lambda t: (day[t][0], t), reverse=True)
        if not best:
            out[date] = 0.0
            continue
        if held:
            worst = sorted(held, key=lambda t: (day[t][0] if t in day and day[t][0] is not None else -np.inf, t))
            gone = worst[:drop]
            stay = [t for t in held if t not in gone]
            new = [t for t in best if t not in stay][:drop]
            held = stay + new
        else:
            held, gone = best[:k], []
            new = held
        gain = sum(day[t][1] for t in held if t in day and day[t][1] is not None) / len(held)
        cost = (len(new) * buy + len(gone) * sell) / len(held)
        slips = [day[t][2] for t in held if t in day and day[t][2] is not None]
        cost += (np.mean(slips) if slips else 0.0) * (len(new) + len(gone)) / len(held)
        out[date] = gain - cost
    return out


def by_day(rows, *keys):
    out = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        out[tuple(r[k] for k in keys)][r.date][r.ticker] = (r.signal, r.ret, getattr(r, "slip", None))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_backtest_daily(spark, data):
    rows = by_day(stats.pool_rows(spark, data).collect(), "formula_id")
    want = {(f[0], d): r for f, days in rows.items() for d, r in topk(days, 5, 1).items()}
    close({(r.formula_id, r.date): r.ret for r in registry.QUERIES["backtest_daily"](spark, data).collect()}, want)
    # the measures of those returns
    curve = defaultdict(list)
    for (f, _), r in sorted(want.items()):
        curve[f].append(r)
    for m in registry.QUERIES["backtest_metrics"](spark, data).collect():
        r = np.array(curve[m.formula_id])
        e = np.cumprod(1 + r)
        assert np.isclose(m.net_return, (e[-1] - 1) * 100, rtol=1e-6, atol=1e-2) and abs(m.mdd - (e / np.maximum.accumulate(e) - 1).min() * 100) < 1e-2


def test_backtest_with_costs_of_trading(spark, data):
    rows = stats.pool_rows(spark, data).join(simulate.unit_slippage(common.monthly(spark, data)).withColumn("slip", F.col("slip") / 1e4), ["ticker", "date"])
    scaled = simulate.vol_targeted(rows)
    plain = by_day(scaled.collect(), "formula_id")
    want = {(f[0], d): r for f, days in plain.items() for d, r in topk(days, 5, 1).items()}
    close({(r.formula_id, r.date): round(r.ret, 6) for r in simulate.topk_dropout(scaled, 5, 1).collect()}, want)
    assert registry.QUERIES["backtest_risk"](spark, data).count() == len(want)
    # the scale of one ticker by pandas, from yesterday's deviations of its returns
    one = pd.DataFrame([(r.date, r.ret) for r in rows.where("formula_id = 'level'").collect() if r.ticker == 1], columns=["date", "ret"]).sort_values("date")
    vol = pd.concat([one.ret.rolling(20, min_periods=5).std(), one.ret.ewm(span=5, min_periods=2).std()], axis=1).max(axis=1) * np.sqrt(252)
    scale = (0.15 / vol.replace(0, np.nan)).fillna(1.0).clip(0.1, 3.0).shift(1).fillna(1.0)
    got = {r.date: r.ret for r in scaled.where("formula_id = 'level' and ticker = 1").collect()}
    assert all(abs(got[d] - r * s) < 1e-9 for d, r, s in zip(one.date, one.ret, scale) if not np.isnan(r))


def test_walk_forward_and_refit(spark, data):
    base = common.with_ret(common.monthly(spark, data)).withColumn("size", F.ln("pclose"))
    spans = overfit.windows(base, 12, 12)
    rows = compiler.signals(overfit.in_windows(base, spans), stats.POOL, "ret", by=F.col("ticker.window_id"))
    flat = rows.select("formula_id", F.col("ticker.window_id").alias("window_id"), F.col("ticker.ticker").alias("ticker"), "date", "signal", "ret").collect()
    # clipped inside each window: no value of a window is beyond its own quantiles
    raw = compiler.long(compiler.evaluate(overfit.in_windows(base, spans), stats.POOL), list(stats.POOL), "ret").select("formula_id", "ticker.window_id", "signal").toPandas()
    for (f, w), g in raw.groupby(["formula_id", "window_id"]):
        mine = [r.signal for r in flat if r.formula_id == f and r.window_id == w]
        lo, hi = np.quantile(g.signal, [0.005, 0.995])
        assert abs(min(mine) - np.clip(g.signal, lo, hi).min()) < 1e-12 and abs(max(mine) - np.clip(g.signal, lo, hi).max()) < 1e-12
    want = {(f, w, d): r for (f, w), days in by_day(flat, "formula_id", "window_id").items() for d, r in topk(days, 5, 1).items()}
    close({(r.formula_id, r.window_id, r.date): r.ret for r in registry.QUERIES["backtest_walk_forward"](spark, data).collect()}, want)
    refit = registry.QUERIES["rolling_refit"](spark, data).toPandas()
    fame = registry.QUERIES["hall_of_fame_equity"](spark, data).toPandas()
    for f, g in refit.sort_values("window_id").drop_duplicates(["formula_id", "date"]).groupby("formula_id"):
        e = fame[fame.formula_id == f].sort_values("date").equity.to_numpy()
        assert np.allclose(e, 100_000 * np.cumprod(1 + g.sort_values("date").ret.to_numpy()), rtol=1e-4)


def test_full_evaluation(spark, data):
    got = {r.formula_id: r for r in registry.QUERIES["full_evaluation"](spark, data).collect()}
    means = {r.formula_id: r for r in registry.QUERIES["ic_summary"](spark, data).collect()}
    for f, r in got.items():
        assert abs(r.ic - means[f].ic) < 1e-4 and abs(r.rank_ic - means[f].rank_ic) < 1e-4


def test_quantile_edges(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 100, 201, 5000):
        for x in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.zeros(n)):
            df = spark.createDataFrame([(0, float(v)) for v in x] + [(0, None)], "g int, x double")
            r = compiler.quantile_edges(df, ["g"], "x", 0.005, 0.995, accuracy=200).first()
            assert np.allclose([r.lo, r.hi], np.quantile(x, [0.005, 0.995]), atol=1e-12), (n, r)


def test_hidden_states(spark):
    rng = np.random.default_rng(3)
    a, pi = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.5, 0.5])
    m, s = np.array([[0.0], [3.0]]), np.array([[1.0], [0.5]])
    x = rng.normal(size=9)
    model = {"k": 2, "pi": pi.tolist(), "a": a.tolist(), "m": m.tolist(), "s": s.tolist()}
    df = spark.createDataFrame([("all", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "ticker string, date date, x double")
    import itertools

    b = np.exp(-0.5 * (x[:, None] - m[:, 0]) ** 2 / s[:, 0]) / np.sqrt(s[:, 0])
    weight = {z: pi[z[0]] * np.prod([a[i, j] for i, j in zip(z, z[1:])]) * np.prod([b[t, i] for t, i in enumerate(z)]) for z in itertools.product((0, 1), repeat=len(x))}
    for smooth in (False, True):
        got = [r.smoothed if smooth else r.filtered for r in sorted(chain.probabilities(df, ["x"], model, days=2, width=2).collect(), key=lambda r: r.date)]
        for t, p in enumerate(got):
            some = weight if smooth else {z: pi[z[0]] * np.prod([a[i, j] for i, j in zip(z, z[1:])]) * np.prod([b[u, i] for u, i in enumerate(z)]) for z in itertools.product((0, 1), repeat=t + 1)}
            want = sum(w for z, w in some.items() if z[t] == 1) / sum(some.values())
            assert abs(p[1] - want) < 1e-9
    assert regime.align_states(np.array([[0.0], [1.0], [5.0]]), np.array([[5.1], [0.1], [0.9]])) == [1, 2, 0]


def test_stores(spark, tmp_path):
    at = f"file://{tmp_path}"
    store = catalog.Catalog(spark, f"{at}/cat")
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([("A", 0.1), ("B", 0.2)], "formula string, rank_ic double"))
    store.upsert(spark.createDataFrame([("A", 0.3)], "formula string, rank_ic double"))
    store.deactivate(spark.createDataFrame([("B",), ("none",)], "formula string"), "2020-01-02")
    got = {r.formula: r for r in store.read().collect()}
    assert got["A"].rank_ic == 0.3 and got["A"].live and got["B"].rank_ic == 0.2 and not got["B"].live and got["B"].deactivated_at == "2020-01-02" and len(got) == 2
    for day in range(1, 10):
        store.snapshot(f"2020-01-{day:02d}")
        store.snapshot(f"2020-01-{day:02d}")
    assert len(list((tmp_path / "cat/snapshots").iterdir())) == 7
    catalog.put_text(spark, catalog.KillSwitch().on("loss", dt.datetime(2020, 1, 1, tzinfo=dt.UTC)), f"{at}/switch")
    state = catalog.get_text(spark, f"{at}/switch")
    assert catalog.KillSwitch().active(state, dt.datetime(2020, 1, 1, 12, tzinfo=dt.UTC)) and not catalog.KillSwitch().active(state, dt.datetime(2020, 1, 2, 1, tzinfo=dt.UTC))
    assert catalog.get_text(spark, f"{at}/nothing") is None
    regime.save_hmm(spark, {"k": 2}, f"{at}/hmm", fitted="2020")
    assert regime.load_hmm(spark, f"{at}/hmm") == ({"k": 2}, {"fitted": "2020"})
    pd.DataFrame({"Date": ["2020-01-02"], "close": [5.0]}).to_csv(tmp_path / "b.csv", index=False)
    assert panel.read_benchmark(spark, f"{at}/none.parquet", f"{at}/b.csv").first().close == 5.0
    with pytest.raises(FileNotFoundError):
        panel.read_benchmark(spark, f"{at}/none.parquet")
    days = spark.createDataFrame([(dt.date(2020, 1, 1),)], "date date")
    panel.require_fresh(days, dt.date(2020, 1, 4))
    with pytest.raises(RuntimeError):
        panel.require_fresh(days, dt.date(2020, 1, 5))
    assert MiningSettings.load('{"mining": {"seed": 7, "other": 1}}').seed == 7 and MiningSettings.of({}).rounds == 2
    new = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in panel.upsert(spark.createDataFrame([(1, "z"), (2, "y")], "k int, v string"), new, ["k"]).collect()) == [(1, "b"), (2, "y"), (3, "c")]


# The recipe of the public synthetic market and the fitness published for it.
SEED, TICKERS, DAYS = 314159, 25, 400
PUBLISHED = {
    "Delta(Pclose, 5)": ("ok", 0.002580941740778637, -0.010300045050195897, 1, 4),
    "Std(Pclose, 20)": ("ok", -0.012837617257716961, -0.27759090366413186, 0, 4),
    "Mean(Pclose, 20)": ("size_factor", None, -1e9, 0, 0),
    "Rank(Pclose, 20)": ("ok", 0.008471594333684378, -0.0016976623711551161, 3, 4),
    "Corr(Pclose, Vlot, 20)": ("ok", 0.004562236264200218, -0.008193823212576747, 2, 4),
}


def synthetic_market():
    rng = np.random.default_rng(SEED)
    days = pd.bdate_range("2020-01-01", periods=DAYS)
    rows = []
    for t, start in enumerate(np.linspace(5.0, 300.0, TICKERS)):
        drift, vol = rng.uniform(-1e-4, 3e-4), rng.uniform(0.01, 0.03)
        price = start * np.exp(np.cumsum(rng.normal(drift, vol, DAYS)))
        for day, p in zip(days, price):
            high, low = p * (1 + abs(rng.normal(0, 0.007))), p * (1 - abs(rng.normal(0, 0.007)))
            first, volume = p * (1 + rng.normal(0, 0.004)), abs(rng.normal(1e6, 2e5))
            rows.append((f"T{t:03d}", day.date(), float(first), float(high), float(low), float(p), float(volume)))
    return rows


def test_published_fitness(spark):
    market = panel.with_typical(spark.createDataFrame(synthetic_market(), "ticker string, date date, popen double, phigh double, plow double, pclose double, vlot double"))
    market = market.withColumn("ret", panel.next_return()).withColumn("size", F.ln("pclose"))
    pool = {f"f{k}": f for k, f in enumerate(PUBLISHED)}
    rows = compiler.signals(market, pool, "ret", "size")
    days = sorted(r.date for r in market.select("date").distinct().collect())
    per = ic.fold_ics(ic.daily(rows), ic.fold_table(spark, ic.folds(days, 4, 3, 30)))
    cx = spark.createDataFrame([(k, parse(f).size) for k, f in pool.items()], "formula_id string, complexity int")
    for r in ic.fitness(per, cx, ic.size_corr(rows)).collect():
        status, mean, fit, positive, folds = PUBLISHED[pool[r.formula_id]]
        assert r.status == status, (pool[r.formula_id], r)
        if status == "ok":
            assert abs(r.mean_ric - mean) <= 0.05 * abs(mean) and abs(r.fitness - fit) <= 0.05 * abs(fit) and (r.pos_folds, r.n_folds) == (positive, folds), (pool[r.formula_id], r)
