"""State with timers, initial state, and the interval join of entries and prices, restarts included."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import simulate
from alphaloom.streaming import decay, paper

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def feed(spark, tmp_path, parts, build, schema):
    """Each part is a run of the stream: new files, a start from the checkpoint, all that is there, a stop."""
    out = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        found = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
        out.append(found)
    return out


def test_a_switch_ends_by_its_timer(spark, tmp_path):
    parts = [
        [("a", T0, "loss"), ("a", T0 + 10 * H, "drawdown"), ("b", T0, "loss")],  # again: 24 hours from the second alarm
        [("clock", T0 + 30 * H, "")],  # b's timer is due, a's is not
        [("clock", T0 + 35 * H, "")],
        [("a", T0 + 100 * H, "loss"), ("a", T0 + 200 * H, "loss")],  # the first ends because the second is later
    ]
    one, two, three, four = feed(spark, tmp_path, parts, lambda s: decay.kill_switch(s).where("account <> 'clock'"), "account string, at timestamp, reason string")
    first = {("a", T0, "on", "loss"), ("a", T0 + 10 * H, "again", "drawdown"), ("b", T0, "on", "loss")}
    assert set(one) == first
    assert set(two) - set(one) == {("b", T0 + 24 * H, "off", "loss")}
    assert set(three) - set(two) == {("a", T0 + 34 * H, "off", "drawdown")}
    assert set(four) - set(three) == {("a", T0 + 100 * H, "on", "loss"), ("a", T0 + 124 * H, "off", "loss"), ("a", T0 + 200 * H, "on", "loss")}


def test_decay_begins_where_a_batch_ended(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, T0 + dt.timedelta(days=i), None if i % 9 == 4 else float(x), 0.01, 0.004) for k in ("a", "b", "c") for i, x in enumerate(rng.normal(0.0, 0.008, 60))]
    schema = "formula_id string, date timestamp, ret double, mu double, sigma double"
    df = spark.createDataFrame(rows, schema)
    batch = lambda d: {r.formula_id: r for r in simulate.page_hinkley(d.withColumn("date", F.to_date("date")), patience=2).collect()}
    cut = T0 + dt.timedelta(days=6)
    before = [(r.formula_id, r.m, r.alarms, None if r.triggered_at is None else dt.datetime.combine(r.triggered_at, dt.time()), r.n_observations) for r in batch(df.where(F.col("date") < F.lit(cut))).values() if r.formula_id != "c"]
    initial = spark.createDataFrame(before, "formula_id string, m double, alarms int, triggered_at timestamp, n int")
    rest = df.where((F.col("date") >= F.lit(cut)) | (F.col("formula_id") == "c"))
    rest.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    q = decay.decay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), patience=2, initial=initial)
    q.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r.formula_id: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = batch(df)
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.n_observations, r.alarms, r.triggered) == (want[k].n_observations, want[k].alarms, want[k].triggered) and r.m == pytest.approx(want[k].m)


def test_fills_wait_for_late_prices_and_give_up(spark, tmp_path):
    day = lambda i: T0 + dt.timedelta(days=i)
    entry, price = "ticker int, date timestamp, exit_day int, entry_px double, slippage_bps double", "ticker int, date timestamp, day int, pclose double"
    runs = [
        ([(1, day(0), 2, 10.0, 20.0), (2, day(0), 2, 10.0, 20.0), (3, day(0), 2, 10.0, 20.0)], [(1, day(2), 2, 11.0), (1, day(3), 3, 99.0)]),
        ([(1, day(5), 7, 10.0, 0.0)], [(2, day(2), 2, 16.0), (1, day(7), 7, 12.0)]),  # a price out of order, and a jump
        ([(-1, day(60), -1, 0.0, 0.0)], [(-1, day(60), -1, 0.0)]),  # the clock goes on
        ([], [(3, day(2), 2, 10.5)]),  # too late
    ]
    got = []
    for e, p in runs:
        spark.createDataFrame(e, entry).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame(p, price).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        s = paper.fills(spark.readStream.schema(entry).parquet(str(tmp_path / "e")), spark.readStream.schema(price).parquet(str(tmp_path / "p")), span="10 days", delay="5 days")
        s.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        got.append({(r.ticker, r.date): (r.exit_px, r.gross_pnl_pct, r.net_pnl_pct) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()})
    assert got[0] == {(1, day(0)): (11.0, pytest.approx(0.1), pytest.approx(0.098))}
    assert got[1] == got[0] | {(2, day(0)): (16.0, None, None), (1, day(5)): (12.0, pytest.approx(0.2), pytest.approx(0.2))}
    assert got[2] == got[1] | {(3, day(0)): (None, None, None)} and got[3] == got[2]
    pending = spark.createDataFrame([(3, day(0), day(2), 10.0, 20.0)], "ticker int, date timestamp, exit_date timestamp, entry_px double, slippage_bps double")
    late = simulate.realized_pnl(pending, spark.createDataFrame(runs[3][1], price)).first()
    assert late.gross_pnl_pct == pytest.approx(0.05)
