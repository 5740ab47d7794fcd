"""Pools scored from columns: shuffles follow turns of ticker and date, not depth or number of formulas."""

import datetime as dt
import random

from pyspark.sql import functions as F

from alphaloom.operators import ic
from alphaloom.plans.compiler import evaluate, long
from alphaloom.queries import stats


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_days_of_a_pool_are_those_of_its_stacked_rows(spark):
    rng = random.Random(3)
    some = lambda *v: rng.choice(v)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(d), some(None, 0.0, -0.0, 1.0, rng.random()), some(None, 2.0, rng.random()), some(0.0, -0.0, 0.5, rng.random()), 0.0, rng.gauss(0, 1)) for t in range(25) for d in range(9)]
    rows += [(t, dt.date(2021, 1, 1), None, 1.0 * t, 1.0 * (t % 3), 0.0, 1.0) for t in range(7)] + [(1, dt.date(2021, 1, 2), 0.5, None, 0.1, 0.0, 1.0)]
    wide = spark.createDataFrame(rows, "ticker int, date date, ret double, size double, a double, b double, c double")
    ids = ["a", "b", "c"]
    got = ic.pool_days(wide, ids)
    stacked = long(wide, ids, "ret", "size")
    show = lambda df, *names: sorted((r[0], str(r[1]), *[None if v is None else round(v, 9) for v in r[2:]]) for r in df.select("formula_id", *names).collect())
    assert show(got.where("n > 0"), "date", "ic", "rank_ic", "n") == show(ic.daily(stacked), "date", "ic", "rank_ic", "n")
    mean = got.groupBy("formula_id").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("size_corr"))
    pairs = lambda df: {r.formula_id: round(r.size_corr, 9) for r in df.collect()}
    assert pairs(mean) == pairs(ic.size_corr(stacked))
    # the rows of the whole pool are shuffled once
    assert shuffles(got) == 1


def test_nested_windows_are_shuffled_once_a_turn(spark):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(d), float(t + d), float(t * d)) for t in range(4) for d in range(9)]
    panel = spark.createDataFrame(rows, "ticker int, date date, pclose double, vlot double")
    pool = {
        "a": "CSRank(CSRank(Add(CSRank(Vlot), CSRank(Pclose))))",
        "b": "Mean(EMA(Mean(Vlot, 2), 3), 2)",
        "c": "EMA(CSRank(Max(Pclose, 2)), 2)",
        "d": "CSRank(Delta(CSRank(Vlot), 1))",
    }
    # by ticker, date, ticker, date
    assert shuffles(evaluate(panel, pool)) == 4


def test_a_task_holds_a_slice_of_the_pool(spark):
    """However many formulas and however few bytes, a task stacks some formulas of a date or two, not the pool."""
    ids = [f"f{i}" for i in range(8)]
    wide = spark.range(4_000).selectExpr("date_add(date'2020-01-01', cast(id % 10 as int)) date", "rand(1) ret", "rand(2) size", *[f"rand({i}) {k}" for i, k in enumerate(ids)])
    tasks = ic.pool_tasks(10, 4_000, 8)
    assert tasks == 1 and ic.pool_tasks(10, 4_000_000, 8) == 120
    one = {(r.formula_id, r.date): r for r in ic.pool_days(wide, ids, tasks=1).collect()}
    got = ic.pool_days(wide, ids, tasks=120)
    # rows of a task where they are dealt: 400 of a date, for each slice of three formulas
    held = got.select(F.spark_partition_id().alias("p"), "formula_id", "date").groupBy("p").count().agg(F.max("count")).first()[0]
    assert held <= 5 * 3 and shuffles(got) == 1
    same = {(r.formula_id, r.date): r for r in got.collect()}
    near = lambda a, b: a == b or abs(a - b) < 1e-9
    assert same.keys() == one.keys() and len(one) == 80 and all(near(x, y) for k in one for x, y in zip(one[k][2:], same[k][2:]))


def test_lines_are_dealt_before_they_are_sorted(spark, data):
    """Sorting a whole split to reduce its lines took memory by the size of the split."""
    panel = stats.monthly(spark, data)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    # plans are printed from the last step to the first
    assert "SortAggregate" in plan and plan.rindex("SortAggregate") < plan.index("Exchange hashpartitioning")
    assert shuffles(panel) == 1
