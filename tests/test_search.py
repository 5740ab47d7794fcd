"""Batched tree search against a serial one, and tuning."""

import datetime as dt
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row as row
from pyspark.sql import functions as F

from alphaloom.operators import search, tuning
from alphaloom.plans.formula import canonical, generate, mutate, parse
from alphaloom.queries import common


def score(tree):
    return zlib.crc32(canonical(tree).encode()) % 1000 / 1000


class Plain:
    def __init__(self, tree, up=None):
        self.tree, self.up, self.n, self.q, self.kids = tree, up, 0, 0.0, []


def serial(seed, iterations, budget, c, bonus):
    """A tree search one leaf at a time, its means kept as running averages."""
    rng = random.Random(seed)
    root = Plain(generate(rng, budget))
    for _ in range(iterations):
        cur = root
        while cur.kids:
            top = max(bonus.values(), default=1.0) or 1.0
            e = [math.exp(bonus.get(canonical(k.tree), 0) / top) for k in cur.kids]
            n = sum(k.n for k in cur.kids)
            u = [k.q + c * math.sqrt(len(cur.kids) / 8) * x / sum(e) * math.sqrt(n + 1) / (1 + k.n) for k, x in zip(cur.kids, e)]
            cur = cur.kids[u.index(max(u))]
        for _ in range(4):
            cur.kids.append(Plain(mutate(rng, cur.tree) if rng.random() < 0.5 else generate(rng, budget), cur))
        cur = rng.choice(cur.kids)
        v = score(cur.tree)
        while cur:
            cur.n += 1
            cur.q += (v - cur.q) / cur.n
            cur = cur.up
    return root


def same(a, b):
    return str(a.tree) == str(b.tree) and a.visits == b.n and abs(a.value - b.q) < 1e-9 and len(a.children) == len(b.kids) and all(map(same, a.children, b.kids))


def test_one_leaf_a_round_is_the_serial_search():
    bonus = {canonical(parse("Mean(Pclose, 20)")): 0.5, canonical(parse("Log(Vlot)")): 0.2}
    calls = []
    roots = [search.Root(random.Random(s), 9, 1.1) for s in range(4)]
    known = search.grow(roots, 60, lambda trees: calls.append(len(trees)) or [score(t) for t in trees], bonus)
    assert all(same(r.branch, serial(s, 60, 9, 1.1, bonus)) for s, r in enumerate(roots))
    # all roots' leaves of a round are one call; a formula is valued once
    assert len(calls) <= 60 and sum(calls) == len(known) and max(calls) <= 4


def test_virtual_losses_spread_a_rounds_leaves():
    root = search.Root(random.Random(3), 9, leaves=6)
    calls = []
    search.grow([root], 10, lambda trees: calls.append(len(trees)) or [score(t) for t in trees])
    assert len(calls) == 10 and root.branch.visits == 60 and sum(c.visits for c in root.branch.children) == 60
    assert sum(c.visits > 0 for c in root.branch.children) >= 3
    total = lambda b: b.total if not b.children else None
    assert total(root.branch) is None and 0 < root.branch.value < 1
    before = sum(1 for _ in leaves(root.branch))
    search.prune(root.branch)
    assert sum(1 for _ in leaves(root.branch)) < before and all(c.visits != 1 or all(x.visits < 2 for x in root.branch.children) for c in root.branch.children)


def leaves(b):
    yield b
    for c in b.children:
        yield from leaves(c)


def test_canonical_and_bonus(spark):
    assert canonical(parse("Add(Vlot, Mul(Pclose, Popen))")) == canonical(parse("Add(Mul(Popen, Pclose), Vlot)"))
    assert canonical(parse("Sub(Vlot, Pclose)")) != canonical(parse("Sub(Pclose, Vlot)"))
    assert canonical(parse("Corr(Vlot, Pclose, 20)")) == canonical(parse("Corr(Pclose, Vlot, 20)"))
    rows = [("Add(Log(Vlot), Pclose)",), ("Mul(Log(Vlot), Log(Popen))",), ("Mul(Log(Vlot), Log(Popen))",)]
    got = search.subtree_bonus(spark.createDataFrame(rows, "formula string"))
    assert got == {"Log(Vlot)": 0.4, "Log(Popen)": 0.2, "Add(Log(Vlot), Pclose)": 0.2, "Mul(Log(Popen), Log(Vlot))": 0.2}


def test_proposals_find_a_peak():
    space = {"x": tuning.Range(0, 10), "y": tuning.Range(0.001, 1, log=True), "k": tuning.Range(1, 9, whole=True)}
    f = lambda p: -abs(p["x"] - 3) - abs(math.log10(p["y"]) + 2) - abs(p["k"] - 4) / 4
    best = {}
    for how in ("parzen", "chance"):
        best[how] = []
        for seed in range(5):
            rng, done = np.random.default_rng(seed), []
            for _ in range(12):
                done += [(p, f(p)) for p in tuning.propose(rng, done if how == "parzen" else [], 5, space)]
            assert all(0 <= p["x"] <= 10 and 0.001 <= p["y"] <= 1.0001 and p["k"] in range(1, 10) for p, _ in done)
            best[how].append(max(v for _, v in done))
    assert np.mean(best["parzen"]) > np.mean(best["chance"])


def test_halving_and_windows():
    seen = []

    def run(params, rung):
        seen.append((rung, len(params)))
        return [-abs(p["x"] - 5) for p in params]

    out = tuning.halving(run, [{"x": i} for i in range(8)], 3)
    assert seen == [(0, 8), (1, 4), (2, 2)] and len(out) == 8
    assert {p["x"] for p, _, r in out if r == 3} <= {4, 5, 6} and max(out, key=lambda o: (o[2], o[1]))[0] == {"x": 5}
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    assert [d[0] for d in tuning.slices(days, 3)] == [days[30], days[20], days[0]]
    spans = tuning.windows(days, 3, 20)
    assert [(s[0], s[-1]) for s in spans] == [(days[20], days[39]), (days[10], days[29]), (days[0], days[19])]
    with pytest.raises(ValueError):
        tuning.windows(days, 3, 41)
    assert tuning.consensus([{"a": 1, "b": 0.5}, {"a": 2, "b": 1.5}, {"a": 4, "b": 1.0}]) == {"a": 2, "b": 1.0}


def test_trials_share_jobs_and_equal_their_own_runs(spark, data):
    panel = common.with_ret(common.monthly(spark, data)).withColumn("size", F.ln("pclose"))
    rng = np.random.default_rng(1)
    params = tuning.propose(rng, [], 3)
    for p in params:
        p["mcts_rollouts"] = 12
    values, jobs = tuning.run_trials(panel, params, 7, 1, n_folds=2, least_days=5)
    assert jobs == 1 and len(values) == 3 and any(v > tuning.FAILED for v in values)
    alone, one = tuning.run_trials(panel, params[:1], 7, 1, n_folds=2, least_days=5)
    assert one == 1 and alone[0] == pytest.approx(values[0], abs=1e-9)


def test_registered_tuning_is_whole(spark, data, monkeypatch):
    """Fifty trials on the whole of each of three windows, over the parameters' whole ranges; every leaf of a trial is valued."""
    from alphaloom import registry

    seen = {}

    def score_pool(panel, pool, **folds):
        key = tuple(panel.agg(F.min("date"), F.max("date"), F.countDistinct("date")).first())
        asked = seen.setdefault(key, [])
        asked += map(canonical, pool)
        fold_rics = [row(fold=k, ric=score(pool[0])) for k in range(4)]
        rows = [row(formula=str(t), status="ok", mean_ric=score(t), std_ric=0.1, complexity=t.size, size_corr=0.0, fold_rics=fold_rics) for t in pool]
        return type("Scored", (), {"collect": lambda self: rows})()

    trials, run_trials = {}, tuning.run_trials

    def run(panel, params, seed, *a, **k):
        trials.setdefault(seed, []).extend(params)
        return run_trials(panel, params, seed, *a, **k)

    monkeypatch.setattr(search, "score_pool", score_pool)
    monkeypatch.setattr(tuning, "run_trials", run)
    got = registry.QUERIES["tuned_parameters"](spark, data).collect()
    assert len(trials) == len(seen) == 3 and all(len(ps) == 50 for ps in trials.values()) and len(got) == 24
    for k in ("max_K", "mcts_rollouts"):  # every value of the range may be drawn: near both ends some are
        r, tried = tuning.SPACE[k], [p[k] for ps in trials.values() for p in ps]
        assert min(tried) <= r.low + 1 and max(tried) >= r.high - 1
    months = sorted(r.date for r in common.monthly(spark, data).select("date").distinct().collect())
    spans = tuning.windows(months, 3, len(months) * 3 // 4)
    assert seen.keys() == {(s[0], s[-1], len(s)) for s in spans}
    assert all(len(asked) == len(set(asked)) for asked in seen.values())  # a formula is scored once a window


def test_all_leaves_of_a_trial_are_dealt(monkeypatch):
    grown = []
    monkeypatch.setattr(search, "PoolValues", lambda panel: Values())
    monkeypatch.setattr(tuning, "trial_value", lambda rows, p, like: 0.0)
    grow = search.grow
    monkeypatch.setattr(search, "grow", lambda roots, *a: (grow(roots, *a), grown.append([r.branch.visits for r in roots])))
    params = [{"max_K": 9, "c_puct": 1.0, "mcts_rollouts": n} for n in (8, 11, 31)]
    tuning.run_trials(None, params, 7, 4)
    assert grown[-1] == [8, 11, 31]


class Values:
    jobs, rows = 0, {}

    def __call__(self, trees):
        return [score(t) for t in trees]


def test_mining_gates(spark, data):
    """The registered mining, its gates in plain Python over the scores of the same generations."""
    from statistics import NormalDist

    from alphaloom import registry
    from alphaloom.operators import overfit

    panel = common.with_ret(common.monthly(spark, data)).withColumn("size", F.ln("pclose"))
    rng, parents, kept, failed = random.Random(7), [], {}, 0
    for _ in range(2):
        for r in search.score_pool(panel, search.breed(rng, parents, 12)).collect():
            if r.status == "ok" and r.mean_ric >= 0.003 and r.pos_folds >= 0.4 * r.n_folds:
                kept[r.formula] = r
            else:
                failed += 1
        parents = [parse(f) for f in sorted(kept, key=lambda f: -kept[f].fitness)]
    p = {f: NormalDist().cdf((16 * r.mean_ric - overfit.expected_max_sharpe(24, 60)) * math.sqrt(60)) for f, r in kept.items()}
    want = {f: (round(kept[f].mean_ric, 6), round(v, 4)) for f, v in p.items() if v >= 0.75}
    got = {r.formula: (r.mean_ric, round(r.p, 4)) for r in registry.QUERIES["mined_pool"](spark, data).collect()}
    assert failed and want and got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=2e-3) for f in want)


def test_lines_are_read_in_parallel_as_on_the_driver(spark, data):
    from alphaloom import registry
    from alphaloom.plans import formula as L
    from alphaloom.queries import more

    pairs = [(r.l_suppkey, r.y) for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct().collect()]
    want = [(text, str(t) if t else None, t.size if t else None, e) for line in more.formula_lines(*zip(*pairs)) for text, t, e in L.parse_lines(line)]
    got = [(r.text, r.formula, r.complexity, r.error) for r in registry.QUERIES["parse_table"](spark, data).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 0 < sum(e is not None for *_, e in got) < len(got) < len(pairs)  # comments are left out
