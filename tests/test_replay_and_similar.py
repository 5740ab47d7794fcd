"""The replay store, similar formulas, and files by symbol."""

import datetime as dt
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import similar
from alphaloom.plans import formula as L
from alphaloom.sources import symbols
from alphaloom.sources.replay import ReplayStore


def key(r):
    return (r.ast, r.at, r.batch)


def test_newest_rows_stay_whatever_is_compacted(spark, tmp_path):
    stores = [ReplayStore(spark, f"file://{tmp_path}/{n}", capacity=25) for n in "ab"]
    for i in range(5):
        rows = spark.createDataFrame([(f"f{i}{j}", j / 10, [0.5, 0.5] if j % 2 else None, j) for j in range(9)], "ast string, ic double, visits array<double>, at bigint")
        for s in stores:
            s.append(rows.repartition(1 + i))
        if i in (1, 3):
            assert stores[1].compact()
    a, b = ({(r.ast, r.at) for r in s.read().collect()} for s in stores)
    assert a == b == {(f"f{i}{j}", j) for i in range(5) for j in range(9) if i >= 3 or i == 2 and j >= 2}
    assert len(list((tmp_path / "b/data").iterdir())) == 2 and {r.batch for r in stores[0].read().collect()} == {3, 4, 5}
    one = [key(r) for r in stores[0].sample(10, 3).collect()]
    two = [key(r) for r in ReplayStore(spark, stores[0].path, 25).sample(10, 3).collect()]
    assert one == two and len(set(one)) == 10 and set(one) != {key(r) for r in stores[0].sample(10, 4).collect()}
    assert stores[0].sample(100, 1).count() == 25 and ReplayStore(spark, f"file://{tmp_path}/none").sample(5, 1).count() == 0


def test_samples_are_even(spark, tmp_path):
    store = ReplayStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(20).select(F.col("id").cast("string").alias("ast"), F.lit(0.1).alias("ic"), F.col("id").alias("at")))
    drawn = [r.ast for seed in range(20) for r in store.sample(5, seed).collect()]
    assert len(set(drawn)) == 20


def test_appends_at_once(spark, tmp_path):
    store = ReplayStore(spark, f"file://{tmp_path}/s")
    rows = lambda i: spark.createDataFrame([(f"x{i}", 0.0)], "ast string, ic double")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: ReplayStore(spark, store.path).append(rows(i)), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4] and {r.ast for r in store.read().collect()} == {"x0", "x1", "x2", "x3"}


def test_json(spark, tmp_path):
    tree = {"k": "feature", "o": "Pclose", "c": []}
    (tmp_path / "b.json").write_text(json.dumps({"version": 3, "data": [[tree, 0.25, [0.1, 0.9]], [tree, -0.5, None], [tree, "broken", None], [None, 1.0, None]]}))
    store = ReplayStore(spark, f"file://{tmp_path}/s")
    store.import_json(f"file://{tmp_path}/b.json")
    got = [(json.loads(r.ast), r.ic, r.visits, r.at) for r in store.read().orderBy("at").collect()]
    assert got == [(tree, 0.25, [0.1, 0.9], 0), (tree, -0.5, None, 1)]
    assert str(L.Node.from_json(json.dumps(got[0][0]))) == "Pclose"
    store.export_json(f"{tmp_path}/out")
    assert len(spark.read.json(f"{tmp_path}/out").collect()) == 2


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_are_all_found(spark, threshold):
    rng = random.Random(4)
    pool = [L.generate(rng, 12) for _ in range(40)]
    pool += [L.mutate(rng, t) for t in pool for _ in range(2)]
    pool = sorted({str(t) for t in pool})
    df = spark.createDataFrame([(f,) for f in [*pool, pool[0], None]], "formula string")
    got = {(r.formula_a, r.formula_b): r.similarity for r in similar.similar_pairs(df, threshold).collect()}
    trees = {f: L.parse(f) for f in pool}
    want = {(a, b): s for a in pool for b in pool if a < b and (s := L.similarity(trees[a], trees[b])) >= threshold - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and (want or threshold == 1.0)


def test_files_by_symbol(spark, tmp_path):
    day = lambda i: (dt.date(2020, 1, 1) + dt.timedelta(i)).isoformat()
    head = "Date,Open,High,Low,Close,Volume\n"
    body = lambda n: "".join(f"{day(i)},1,3,1,2,{100 + i}\n" for i in range(n))
    (tmp_path / "AAA.csv").write_text(head + body(60) + f"{day(0)},9,9,9,9,9\n")
    (tmp_path / "SHORT.csv").write_text(head + body(49))
    (tmp_path / "EMPTY.csv").write_text(head)
    (tmp_path / "OTHER.csv").write_text(head + body(60))
    (tmp_path / "ODD.csv").write_text(head + body(50) + "no date,1,1,1,1,1\n")
    asked = spark.createDataFrame([(s,) for s in ("AAA", "SHORT", "EMPTY", "NONE", "ODD", "AAA")], "ticker string")
    shares = spark.createDataFrame([("AAA", 5.0)], "ticker string, shares_outstanding double")
    panel, missing = symbols.build_panel(spark, f"file://{tmp_path}", asked, shares)
    got = {r.ticker: (r.n, r.s) for r in panel.groupBy("ticker").agg(F.count("*").alias("n"), F.max("shares_outstanding").alias("s")).collect()}
    assert got == {"AAA": (60, 5.0), "ODD": (50, None)}
    assert panel.where("ticker = 'AAA' and date = '2020-01-01'").first().popen == 1.0 and panel.first().ptyp == 2.0
    assert {(r.ticker, r.reason) for r in missing.collect()} == {(s, "empty_or_short") for s in ("SHORT", "EMPTY", "NONE")}
