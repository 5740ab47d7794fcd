"""The catalogue: commits by several writers, champions, migration of old records."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from alphaloom.sources import catalog
from alphaloom.sources.commits import CommitLog, Conflict

ROW = "formula string, rank_ic double"


def fresh(spark, tmp_path, **kw):
    return catalog.Catalog(spark, f"file://{tmp_path}/cat", **kw)


def one(spark, formula, value, **more):
    return spark.createDataFrame([(formula, value)], ROW).withColumns({k: F.lit(v) for k, v in more.items()})


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.numbers() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.create(1, {"by": i}), range(8)))
    assert sum(won) == 1 and log.numbers() == [1] and log.read(1) == {"by": won.index(True)}
    assert not log.create(1, {"by": "late"}) and log.create(2, {}) and len(list((tmp_path / "log").iterdir())) == 2


def test_other_file_systems_rename(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CommitLog, "_local", lambda self: None)
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.create(1, {"a": 1}) and not log.create(1, {"a": 2}) and log.read(1) == {"a": 1} and log.numbers() == [1]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store = fresh(spark, tmp_path, full_every=3)
    store.upsert(one(spark, "F", 0.0))

    def write(i):
        other = fresh(spark, tmp_path, full_every=3)  # as another process would
        other.upsert(one(spark, f"G{i}", float(i)))
        # each adds one to what the record holds: a lost update would show
        other.transact(lambda before: before.where("formula = 'F'").withColumn("rank_ic", F.col("rank_ic") + 1))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    got = {r.formula: r.rank_ic for r in store.read().collect()}
    assert got == {"F": 4.0, "G0": 0.0, "G1": 1.0, "G2": 2.0, "G3": 3.0}
    assert store.log.numbers() == list(range(1, len(store.log.numbers()) + 1))
    assert len(list((tmp_path / "cat/data").iterdir())) == len(store.log.numbers())  # nothing of lost attempts stays


def test_a_change_is_made_again_on_what_another_wrote(spark, tmp_path):
    store, seen = fresh(spark, tmp_path), []
    store.upsert(one(spark, "A", 1.0))

    def change(before):
        seen.append({r.formula for r in before.collect()})
        if len(seen) == 1:
            fresh(spark, tmp_path).upsert(one(spark, "B", 2.0))
        return before.where("formula = 'A'").withColumn("rank_ic", F.lit(float(before.count())))

    assert store.transact(change) == 3 and seen == [{"A"}, {"A", "B"}]
    assert {r.formula: r.rank_ic for r in store.read().collect()} == {"A": 2.0, "B": 2.0}
    assert {r.formula: r.rank_ic for r in store.read(1).collect()} == {"A": 1.0}

    class Busy(CommitLog):
        def create(self, number, content):
            return False

    store.log = Busy(spark, store.log.path)
    with pytest.raises(Conflict):
        store.transact(lambda before: before, attempts=2)


def test_one_champion_a_regime(spark, tmp_path):
    store = fresh(spark, tmp_path)
    store.upsert(spark.createDataFrame([("A", 0.1), ("B", 0.2), ("C", 0.3)], ROW))
    of = lambda: {r.formula: r.regime_champion_for for r in store.read().collect()}
    store.crown(0, "A", "2020-01-01")
    store.crown(1, "C", "2020-01-01")
    store.crown(0, "B", "2020-01-02")
    assert of() == {"A": None, "B": 0, "C": 1}
    store.crown(1, "B", "2020-01-03")  # a formula is champion of one regime
    assert of() == {"A": None, "B": 1, "C": None}
    with pytest.raises(ValueError, match="one champion"):
        store.upsert(one(spark, "D", 0.9, regime_champion_for=1))
    with pytest.raises(ValueError, match="once"):
        store.upsert(spark.createDataFrame([("E", 0.1), ("E", 0.2)], ROW))
    with pytest.raises(ValueError, match="no live"):
        store.crown(0, "none", "2020-01-04")
    assert set(of()) == {"A", "B", "C"}
    store.deactivate(spark.createDataFrame([("B",), ("none",)], "formula string"), "2020-01-05")
    assert of() == {"A": None, "B": None, "C": None} and catalog.champions(store.read()).count() == 0
    with pytest.raises(ValueError, match="no live"):
        store.crown(0, "B", "2020-01-06")
    store.upsert(one(spark, "D", 0.9, regime_champion_for=1))
    assert [r.formula for r in catalog.champions(store.read()).collect()] == ["D"]


def test_full_commits_and_old_numbers(spark, tmp_path):
    store = fresh(spark, tmp_path, full_every=4)
    for i in range(7):
        store.upsert(one(spark, f"F{i % 3}", float(i)))
    full = [n for n in store.log.numbers() if store.log.read(n)["full"]]
    assert full == [5] or full == [5, 9]
    assert {r.formula: r.rank_ic for r in store.read().collect()} == {"F0": 6.0, "F1": 4.0, "F2": 5.0}
    assert {r.formula: r.rank_ic for r in store.read(3).collect()} == {"F0": 0.0, "F1": 1.0, "F2": 2.0}


def test_old_records(spark, tmp_path):
    records = [
        {"formula": "v1", "rank_ic": -0.2},
        {"formula": "v2", "rank_ic": -0.2, "adj_ic": 0.1, "_schema": 2},
        {"formula": "v3", "rank_ic": 0.3, "adj_ic": 0.1, "wf": {"fitness": 0.5}, "overfit": {"verdict": "low"}, "_schema": 3},
        {"formula": "v4", "rank_ic": 0.3, "wf": {"fitness": 0.5, "fold_rics": [0.1], "size_corr": 0.2}, "overfit": {"ic_drop_pct": 3.0}, "_schema": 4},
        {"formula": "v5", "rank_ic": 0.3, "ast_schema": 7, "live": False, "source": "gp", "_schema": 5},
    ]
    (tmp_path / "old.json").write_text(json.dumps(records))
    store = fresh(spark, tmp_path)
    store.import_json(f"file://{tmp_path}/old.json")
    got = {r.formula: r for r in store.read().collect()}
    assert all(r._schema == 5 for r in got.values()) and len(got) == 5
    assert [got[f"v{i}"].adj_ic for i in range(1, 6)] == [0.2, 0.1, 0.1, None, None]
    assert [got[f"v{i}"].ast_schema for i in range(1, 6)] == [1, 1, 1, 1, 7]
    assert got["v1"].wf is None and got["v3"].wf.fold_rics is None and got["v3"].overfit.ic_drop_pct is None and got["v4"].wf.size_corr == 0.2
    assert [got[f"v{i}"].live for i in (1, 5)] == [True, False] and got["v1"].source == "unknown" and got["v5"].source == "gp"
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(Exception):
        store.import_json(f"file://{tmp_path}/broken.json")
    assert store.log.numbers() == [1]
