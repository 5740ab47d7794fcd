"""Hidden Markov models by scan against plain recursions over whole series."""

import datetime as dt

import numpy as np
import pytest

from alphaloom import registry
from alphaloom.operators import chain
from alphaloom.queries import stats


def plain_em(series, spec, rounds):
    """Textbook forward-backward in Python over each whole series, one model; returns the model and its log likelihood before the last update."""
    k, pi, a, m, s = len(spec["pi"]), *(np.array(spec[n], float) for n in ("pi", "a", "m", "s"))
    for _ in range(rounds):
        n, likely, pis, g, gx, gxx, steps = 0, 0.0, 0, 0, 0, 0, 0
        for x in series:
            b = np.exp(-0.5 * ((x[:, None] - m) ** 2 / s + np.log(2 * np.pi * s)).sum(axis=2))
            alpha, beta, scale = np.zeros((len(x), k)), np.ones((len(x), k)), np.zeros(len(x))
            for t in range(len(x)):
                z = (pi if t == 0 else alpha[t - 1] @ a) * b[t]
                scale[t], alpha[t] = z.sum(), z / z.sum()
            for t in range(len(x) - 2, -1, -1):
                beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            for t in range(len(x) - 1):
                xi = alpha[t][:, None] * a * b[t + 1] * beta[t + 1]
                steps = steps + xi / xi.sum()
            n, likely, pis, g = n + len(x), likely + np.log(scale).sum(), pis + gamma[0], g + gamma.sum(axis=0)
            gx, gxx = gx + gamma.T @ x, gxx + gamma.T @ (x * x)
        pi, a, m = pis / len(series), steps / steps.sum(axis=1, keepdims=True), gx / g[:, None]
        s = np.maximum(gxx / g[:, None] - m * m, 1e-4)
    return pi, a, m, s, likely


def made(seed=4):
    rng, series = np.random.default_rng(seed), {}
    for i, n in enumerate((1, 2, 7, 40, 90)):
        z, x = rng.integers(2), []
        for _ in range(n):
            z = z if rng.random() < 0.9 else 1 - z
            x.append(rng.normal((0.0, 2.0)[z], (1.0, 0.5)[z], 2))
        series[i] = np.array(x)
    return series


def frame(spark, series):
    rows = [(i, dt.date(2019, 12, 20) + dt.timedelta(days=3 * t), *map(float, v)) for i, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "ticker int, date date, a double, b double")


@pytest.mark.parametrize("days,width", [(3, 3), (5_000, 256)])
def test_fit_equals_plain(spark, days, width):
    series = made()
    begin = [chain.start(frame(spark, series), ["a", "b"], k) for k in (2, 3)]
    rounds = 3
    got = chain.fit(frame(spark, series), ["a", "b"], begin, rounds=rounds, days=days, width=width)
    for g, spec in zip(got, begin):
        pi, a, m, s, likely = plain_em(list(series.values()), spec, rounds)
        for want, have in zip((pi, a, m, s), ("pi", "a", "m", "s")):
            assert np.allclose(want, g[have], atol=1e-9), have
        n, k = sum(map(len, series.values())), len(pi)
        assert abs(g["bic"] - (-2 * likely + (k * k - 1 + 2 * k + 3 * k) * np.log(n))) < 1e-6


def test_missing_rows_and_nothing(spark):
    series = made()
    df = frame(spark, series)
    model = {"k": 2, "pi": [0.5, 0.5], "a": [[0.9, 0.1], [0.1, 0.9]], "m": [[0, 0], [2, 2]], "s": [[1, 1], [0.3, 0.3]]}
    gaps = df.unionByName(df.limit(5).selectExpr("ticker", "date", "cast(null as double) a", "b")).unionByName(df.limit(1).selectExpr("cast(null as int) ticker", "date", "a", "b"))
    want = {(r.ticker, r.date): r for r in chain.probabilities(df, ["a", "b"], model).collect()}
    got = {(r.ticker, r.date): r for r in chain.probabilities(gaps, ["a", "b"], model, days=7, width=2).collect()}
    assert got.keys() == want.keys() and len(got) == 140
    assert all(np.allclose(got[k].filtered, want[k].filtered, atol=1e-12) and np.allclose(got[k].smoothed, want[k].smoothed, atol=1e-12) for k in want)
    assert chain.probabilities(df.limit(0), ["a", "b"], model).count() == 0


def test_query_equals_plain(spark, data):
    """The registered fit over all tickers, from its own start, against the plain recursion."""
    from alphaloom.operators import regime

    rows = regime.robust_scale(regime.hmm_features(stats.monthly(spark, data)), stats.CHAIN_NAMES).toPandas().sort_values(["ticker", "date"])
    series = [g[stats.CHAIN_NAMES].to_numpy() for _, g in rows.groupby("ticker")]
    df = spark.createDataFrame(rows)
    found = []
    for k in (2, 3):
        spec = chain.start(df, stats.CHAIN_NAMES, k)
        pi, a, m, s, likely = plain_em(series, spec, 8)
        found.append(({"pi": pi, "a": a, "m": m, "s": s}, -2 * likely + (k * k - 1 + 4 * k + 10 * k) * np.log(len(rows))))
    best = min(found, key=lambda f: f[1])[0]
    want, b = {}, chain.Model({n: v.tolist() for n, v in best.items()})
    for key, g in rows.groupby("ticker"):
        now = None
        for date, x in zip(g["date"], g[stats.CHAIN_NAMES].to_numpy()):
            e, _ = b.emissions(x[None])
            now = (b.pi if now is None else now @ b.a) * e[0]
            now = now / now.sum()
            want[(key, date)] = now
    got = {(r.ticker, r.date): r.p for r in registry.QUERIES["hmm_filtered_probs"](spark, data).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_short_series_are_fitted_without_carries(spark, data, monkeypatch):
    """Series of few dates are a chunk each, so a round is a map; the panel of the query is made once."""
    from alphaloom.operators import regime

    def carried(*_):
        raise AssertionError("products of a series that is one chunk")

    read, scale = [], regime.robust_scale
    monkeypatch.setattr(chain, "products", carried)
    monkeypatch.setattr(regime, "robust_scale", lambda rows, *more: read.append(rows._jdf.queryExecution().executedPlan().toString()) or scale(rows, *more))
    assert registry.QUERIES["hmm_filtered_probs"](spark, data).count() > 0
    assert len(read) == 1 and "Exchange" not in read[0]


def test_chunks_follow_the_dates_of_the_table(spark, monkeypatch):
    df = frame(spark, made())
    assert chain.cut(df, ["a", "b"]).alone and not chain.cut(df, ["a", "b"], days=30).alone
    monkeypatch.setattr(chain, "DAYS", 20)
    # seven dates at most in 20 days: chunks of 40 days, 14 dates
    assert chain.spans(df) == (0, 40)
    monkeypatch.setattr(chain, "CELLS", 50)
    model = {"k": 2, "pi": [0.5, 0.5], "a": [[0.9, 0.1], [0.1, 0.9]], "m": [[0, 0], [2, 2]], "s": [[1, 1], [0.3, 0.3]]}
    short = {(r.ticker, r.date): r for r in chain.probabilities(df, ["a", "b"], model).collect()}
    whole = {(r.ticker, r.date): r for r in chain.probabilities(df, ["a", "b"], model, days=5_000).collect()}
    assert short.keys() == whole.keys() and all(np.allclose(short[k].filtered, whole[k].filtered, atol=1e-12) and np.allclose(short[k].smoothed, whole[k].smoothed, atol=1e-12) for k in whole)
