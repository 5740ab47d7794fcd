"""The control plane, path-dependent operators and statistical properties."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alphaloom.operators import chain, ic, overfit, regime, search, simulate, tuning
from alphaloom.plans import compiler
from alphaloom.plans import formula as L
from alphaloom.sources import catalog, panel
from alphaloom.streaming import decay


def gbm(tickers=8, days=60, seed=42):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        for d, x in zip(pd.bdate_range("2020-01-01", periods=days), p):
            h, l, o, v = rng.normal(0, 0.007, 4)
            rows.append((f"T{t:03d}", d.date(), float(x * (1 + o)), float(x * (1 + abs(h))), float(x * (1 - abs(l))), float(x), float(1e6 * (1 + v))))
    return rows


@pytest.fixture(scope="module")
def market(spark):
    return panel.with_typical(spark.createDataFrame(gbm(), "ticker string, date date, popen double, phigh double, plow double, pclose double, vlot double"))


def test_parse_and_print():
    t = L.parse(" ts_mean( CSRank(delay(close, 3)), 2e1 ) ")
    assert str(t) == "Mean(CSRank(Ref(Pclose, 3.0)), 20)" and t.size == 6
    assert L.Node.from_json(t.to_json()) == t and L.parse(str(t)) == t
    assert str(L.parse("Mul(vwap, -.5)")) == "Mul(Pvwap, -0.5)"
    for bad in ("", "Foo(Pclose)", "Pclose)", "Rank(Pclose)", "Add(Pclose Vlot)", "Add(Pclose,", "nothing", "Mean(Pclose, 3", "1 2", "?"):
        with pytest.raises(L.FormulaError):
            L.parse(bad)
    assert L.status_of(L.parse("Add(1, 2)")) != "ok" and L.status_of(L.parse("Mean(Pclose, 0)")) != "ok" and L.status_of(L.parse("Abs(3)")) != "ok"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_random_formulas(seed):
    rng = random.Random(seed)
    a, b = L.generate(rng, 12), L.generate(rng, 12)
    for t in (a, L.crossover(rng, a, b), L.mutate(rng, a)):
        assert L.parse(str(t)) == t and L.Node.from_json(t.to_json()) == t
    assert L.similarity(a, a) == 1.0 and 0 <= L.similarity(a, b) <= 1
    assert L.generate(random.Random(seed), 12) == a


def _pandas(df, f):
    return df.groupby("ticker", group_keys=False)["x"].apply(f)


@pytest.mark.parametrize(
    "op, f",
    [
        ("EMA({}, 7)", lambda g: g.ewm(span=7, adjust=True, min_periods=7).mean()),
        ("Rank({}, 5)", lambda g: g.rolling(5).apply(lambda a: pd.Series(a).rank(pct=True).iloc[-1])),
        ("WMA({}, 5)", lambda g: g.rolling(5).apply(lambda a: np.average(a, weights=np.arange(1, 6)), raw=True)),
        ("Skew({}, 6)", lambda g: g.rolling(6).skew()),
        ("Kurt({}, 6)", lambda g: g.rolling(6).kurt()),
        ("Med({}, 4)", lambda g: g.rolling(4).median()),
        ("Mad({}, 5)", lambda g: g.rolling(5).apply(lambda a: np.abs(a - a.mean()).mean(), raw=True)),
        ("Std({}, 5)", lambda g: g.rolling(5).std()),
        ("Delta({}, 4)", lambda g: g - g.shift(4)),
    ],
)
def test_rolling_against_pandas(market, op, f):
    # a nested input with warm-up nulls, and nulls inside
    holes = market.withColumn("pclose", F.when(F.dayofmonth("date") == 13, None).otherwise(F.col("pclose")))
    got = compiler.evaluate(holes, {"v": op.format("Log(Pclose)")}, raw=True).select("ticker", "date", "v", F.ln("pclose").alias("x")).toPandas().sort_values(["ticker", "date"])
    want = _pandas(got, f)
    assert np.allclose(got["v"].to_numpy(float), want.to_numpy(float), atol=1e-8, equal_nan=True)


def test_shared_subtrees_are_one_window(market):
    plan = compiler.evaluate(market, {"a": "Mean(Pclose, 5)", "b": "Sub(Mean(Pclose, 5), Pclose)", "c": "Mul(Mean(Pclose, 5), Std(Pclose, 5))"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_invalid_formula_is_zero(market):
    assert compiler.evaluate(market, {"bad": "Add(1, 2)"}).where("bad <> 0").count() == 0


def test_topk_dropout(spark):
    days = [dt.date(2020, 1, d) for d in range(1, 6)]
    rows = [("f", t, d, float((i * 7 + k * 3) % 11) if k else None, 0.01 * (i - 2)) for k, d in enumerate(days) for i, t in enumerate("abcdef")]
    out = simulate.topk_dropout(spark.createDataFrame(rows, "formula_id string, ticker string, date date, signal double, ret double"), 3, 1).orderBy("date").collect()
    assert [r.n_held for r in out] == [0, 3, 3, 3, 3] and [r.n_sold for r in out] == [0, 0, 1, 1, 1]
    signal = {"a": 3, "b": 10, "c": 6, "d": 2, "e": 9, "f": 5}
    first = sorted(signal, key=lambda t: (signal[t], t), reverse=True)[:3]
    gain = sum(0.01 * ("abcdef".index(t) - 2) for t in first) / 3
    assert out[1].ret == pytest.approx(gain - 0.0005)


def test_folds():
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=300)]
    found = ic.folds(days, 5, 3, 20)
    flat = [d for _, f in found for d in f]
    assert len(found) == 5 and len(flat) == len(set(flat)) == 300 - 10 * 3
    for f in ic.purged_folds(days, 5, 5, 3):
        assert not set(f["test"]) & set(f["train"])
        before = [d for d in f["train"] if d < f["test"][0]]
        assert not before or np.busday_count(max(before), f["test"][0]) >= 5


def test_overfitting_statistics(spark):
    rng = np.random.default_rng(1)
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=240)]
    noise = [(f"n{j}", d, float(x)) for j in range(10) for d, x in zip(days, rng.normal(0, 0.01, 240))]
    good = [("g", d, float(x)) for d, x in zip(days, rng.normal(0.006, 0.01, 240))]
    df = spark.createDataFrame(noise + good, "formula_id string, date date, ret double")
    combos = overfit.splits(spark, 6)
    best = overfit.pbo(overfit.pbo_combos(overfit.pnl_slices(df, 6), combos)).first()
    assert best.pbo == 0.0 and best.verdict == "low"
    table = {r.formula_id: r for r in overfit.deflated_sharpe(overfit.sharpe_inputs(df), 50).collect()}
    assert table["g"].p > 0.95 and max(r.sharpe for k, r in table.items() if k != "g") < table["g"].sharpe
    assert overfit.expected_max_sharpe(1000, 250) > overfit.expected_max_sharpe(10, 250) > 0


def test_hidden_markov(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.007, (300, 2)), rng.normal(0.02, 0.03, (300, 2))])
    days = pd.bdate_range("2018-01-01", periods=600)
    rows = [("i", d.date(), float(a), float(b)) for d, (a, b) in zip(days, x)]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double")
    model = chain.select(df, ["a", "b"], (2, 3), 50, rounds=25)
    p = chain.probabilities(df, ["a", "b"], model).orderBy("date").collect()
    assert all(abs(sum(r.filtered) - 1) < 1e-9 for r in p)
    state = np.array([int(np.argmax(r.filtered)) for r in p])
    assert np.mean(state[20:300] == np.bincount(state[20:300]).argmax()) > 0.9
    assert regime.align_states(np.array([[0.0], [5.0]]), np.array([[5.1], [0.2]])) == [1, 0]


def test_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(x), 0.01, 0.004) for k in ("a", "b") for i, x in enumerate(rng.normal(0.0, 0.008, 60))]
    df = spark.createDataFrame(rows, "formula_id string, date timestamp, ret double, mu double, sigma double")
    batch = {r.formula_id: r for r in simulate.page_hinkley(df.withColumn("date", F.to_date("date")), patience=2).collect()}
    got = {}
    for part in ("date < '2024-01-20'", "date >= '2024-01-20'"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = decay.decay_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), patience=2)
        q = q.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r.formula_id: r for r in b.collect()}))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    for r in got.values():
        assert r.n_observations == batch[r.formula_id].n_observations and r.triggered == batch[r.formula_id].triggered
        assert r.m == pytest.approx(batch[r.formula_id].m)


def test_upserts(spark, tmp_path):
    write = decay.upsert_sink(str(tmp_path / "t"), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert {(r.k, r.v) for r in decay.read_upserted(spark, str(tmp_path / "t"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    catalog.append(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "l"))
    catalog.append(spark.createDataFrame([(2,)], "x int"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    k = catalog.KillSwitch()
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert k.active(k.on("loss", now), now) and not k.active(k.on("loss", now), now + dt.timedelta(hours=25)) and not k.active(None)


def test_search(market):
    rng = random.Random(5)
    pool = search.breed(rng, [], 6, 8)
    assert len({str(t) for t in pool}) == 6
    assert tuning.pool_objective([0.1] * 3) == -1e6 and tuning.pool_objective([0.1, 0.2, 0.3, 0.4, 0.5]) == 0.3
    assert search.tree_search(random.Random(1), 40, 8) == search.tree_search(random.Random(1), 40, 8)


def test_register_operator(market, monkeypatch):
    for table in (compiler.SCALAR, L.KIND_OF, L.OPERATORS):  # as they were, for the tests after this one
        for name in set(table) | {"Half"}:
            monkeypatch.setitem(table, name, table.get(name))
    compiler.register("Half", "unary", lambda x: x / 2)
    got = compiler.evaluate(market, {"v": "Half(Pclose)"}).where("abs(v - pclose / 2) > 1e-12").count()
    assert got == 0


def test_regime_weights_uniform(spark):
    days = [(dt.date(2020, 1, d), [0.25] * 4) for d in range(1, 9)]
    w = regime.regime_weights(spark.createDataFrame(days, "date date, p array<double>")).collect()
    assert all(r.weight == pytest.approx(1.0) for r in w)
