"""Ranks and running totals by ranges, unranked combinations, recurrences by chunks: against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import ranges
from alphaloom.operators import overfit
from alphaloom.sources.catalog import keep


def kept(df):
    return keep(df, "test")


def test_ranks_of_hot_ties(spark):
    """A third of the rows hold one value, the clip edges hold more; ties cross many ranges."""
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0.0, -0.0, 0.0, -1.5, 1.5, round(rng.gauss(0, 1), 2)])) for g in ("a", "b") for i in range(900)] + [("c", 0, 5.0), ("d", 0, 1.0), ("d", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else ranges this small become one
    try:
        out = ranges.average_ranks(df, "g", "v", "r", ["i"], kept)
        got = {(r.g, r.i): r.r for r in out.collect()}
        assert out.columns == ["g", "i", "v", "r"]
        assert ranges.by_range(df, [F.col("g"), F.col("v"), F.xxhash64("i")], kept).where("v = 0").select(ranges.PART).distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for g in "abcd":
        values = sorted((v + 0.0, i) for h, i, v in rows if h == g)
        for v, same in itertools.groupby(enumerate(values), key=lambda x: x[1][0]):
            same = list(same)
            for _, (_, i) in same:
                want[(g, i)] = sum(k + 1 for k, _ in same) / len(same)
    assert got == want
    assert ranges.average_ranks(df.limit(0), "g", "v", "r", ["i"], kept).count() == 0


def test_running_totals(spark):
    rows = [(i, (i * 7919) % 1000 - 300) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(4)
    got = {r.k: r.t for r in ranges.running_total(df, [F.desc("k")], F.col("n"), "t", kept).collect()}
    total, want = 0, {}
    for k, n in reversed(rows):
        want[k] = total
        total += n
    assert got == want and ranges.running_total(df.limit(0), [F.col("k")], F.col("n"), "t", kept).count() == 0


@pytest.mark.parametrize("n", [2, 5, 6, 9])
def test_unranked_combinations(spark, n):
    got = {}
    for r in overfit.splits(spark, n).collect():
        got.setdefault(r.combo, []).append((r.slice, r.inside))
    want = list(itertools.combinations(range(n), n // 2))
    assert [tuple(s for s, i in sorted(got[c]) if i) for c in range(len(want))] == want


def test_sampled_combinations(spark):
    for n, most in ((12, 50), (60, 64)):
        rows = overfit.splits(spark, n, most=most, seed=5).where("inside").groupBy("combo").agg(F.sort_array(F.collect_list("slice")).alias("s")).collect()
        ways = [tuple(r.s) for r in sorted(rows, key=lambda r: r.combo)]
        assert len(set(ways)) == most and all(len(w) == n // 2 for w in ways) and ways == sorted(ways)
        again = overfit.splits(spark, n, most=most, seed=6).where("inside").groupBy("combo").agg(F.sort_array(F.collect_list("slice")).alias("s")).collect()
        assert {tuple(r.s) for r in again} != set(ways)
    # one of each part of the range
    total = math.comb(12, 6)
    index = {c: i for i, c in enumerate(itertools.combinations(range(12), 6))}
    ways = [tuple(r.s) for r in overfit.splits(spark, 12, most=50, seed=5).where("inside").groupBy("combo").agg(F.sort_array(F.collect_list("slice")).alias("s")).orderBy("combo").collect()]
    for i, w in enumerate(ways):
        low = i * (total // 50) + min(i, total % 50)
        assert low <= index[w] < low + total // 50 + (i < total % 50)
    with pytest.raises(ValueError):
        overfit.splits(spark, 61)


def test_weighted_means_by_chunks(spark):
    """Over many chunks, with gaps, levels far from 0 and a constant stretch, against pandas."""
    import pandas as pd

    from alphaloom.functions.columns import ewm_mean, ewm_std, numbered

    rng = random.Random(8)
    rows = [(t, i, None if rng.random() < 0.1 else 5.0 if 200 < i < 260 else rng.gauss(1e3 if t else 0.0, 1.0)) for t in (0, 1) for i in range(700)]
    rows += [(2, i, None) for i in range(5)] + [(3, 0, 4.0)]
    df = numbered(spark.createDataFrame(rows, "ticker int, date int, x double"))
    got = {(r.ticker, r.date): r for r in df.select("ticker", "date", *[f(F.col("x"), s).alias(f"{f.__name__}_{s}") for f in (ewm_mean, ewm_std) for s in (3, 5, 40)]).collect()}
    for t in (0, 1, 2, 3):
        x = pd.Series([v for k, _, v in rows if k == t], dtype=float)
        for s in (3, 5, 40):
            mean, std = x.ewm(span=s).mean(), x.ewm(span=s).std()
            for i in range(len(x)):
                r = got[(t, i)]
                for have, want, tol in ((r[f"ewm_mean_{s}"], mean[i], 1e-9), (r[f"ewm_std_{s}"], std[i], 2e-3 if t else 1e-5)):
                    assert (have is None) == (want != want) and (have is None or have == pytest.approx(want, rel=tol, abs=tol)), (t, i, s)
