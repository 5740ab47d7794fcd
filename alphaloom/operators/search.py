"""Search over formulas: mining windows and tree search; pools are evaluated as one Spark job."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import clip, filled
from ..plans.formula import Node, canonical, crossover, generate, mutate, parse, status_of
from ..sources.catalog import discard, keep
from . import ic


def breed(rng: random.Random, parents: list[Node], n: int, budget: int = 15) -> list[Node]:
    """Half new formulas, half offspring (70 % crossover, 30 % mutation); distinct and evaluable."""
    out: dict[str, Node] = {}
    for _ in range(50 * n):
        if len(out) >= n:
            break
        if len(out) < n // 2 or not parents:
            tree = generate(rng, budget)
        elif rng.random() < 0.7 and len(parents) > 1:
            tree = crossover(rng, *rng.sample(parents, 2))
        else:
            tree = mutate(rng, rng.choice(parents))
        if status_of(tree) == "ok":
            out.setdefault(str(tree), tree)
    return list(out.values())


def score_pool(panel: DataFrame, pool: list[Node], n_folds: int = 4, embargo: int = 1, least_days: int = 10) -> DataFrame:
    """Walk-forward fitness of a whole pool: one plan for all signals, one pass by date for all daily ICs and size correlations.

    What is left after that pass, a row for each formula and date, is written: folds, sizes and fitness read it.
    """
    named = {f"f{i:04d}": t for i, t in enumerate(pool)}
    wide = filled(panel, named, "ret", "size")
    counts = {r.date: r.n for r in wide.groupBy("date").agg(F.count("*").alias("n")).collect()}  # a row per day
    days = sorted(counts)
    table = ic.fold_table(panel.sparkSession, ic.folds(days, n_folds, embargo, least_days))
    tasks = ic.pool_tasks(len(days), sum(counts.values()), len(named))
    daily = keep(ic.pool_days(clip(wide, list(named)), list(named), tasks=tasks), "days")
    discard(wide)
    per = ic.fold_ics(daily.where("n > 0"), table)
    size = daily.groupBy("formula_id").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("size_corr"))
    each = per.groupBy("formula_id").agg(F.sort_array(F.collect_list(F.struct("fold", "ric"))).alias("fold_rics"))
    cx = panel.sparkSession.createDataFrame([(k, str(t), t.size) for k, t in named.items()], "formula_id string, formula string, complexity int")
    return ic.fitness(per, cx, size).join(each, "formula_id", "left")


def mine(panel: DataFrame, seed: int = 42, population: int = 20, rounds: int = 2, least_ric: float = 0.003, least_share: float = 0.4) -> DataFrame:
    """Generations of formulas: each bred from those accepted before; the accepted of all rounds, best first."""
    rng, parents, kept = random.Random(seed), [], {}
    panel = keep(panel, "panel")
    for _ in range(rounds):
        for r in score_pool(panel, breed(rng, parents, population)).collect():
            if r.status == "ok" and r.mean_ric >= least_ric and r.pos_folds / r.n_folds >= least_share:
                kept[r.formula] = r.asDict()
        parents = [parse(f) for f in sorted(kept, key=lambda f: -kept[f]["fitness"])]
    rows = sorted(kept.values(), key=lambda r: (-r["fitness"], r["formula"]))
    return panel.sparkSession.createDataFrame([(r["formula"], r["mean_ric"], r["fitness"], r["complexity"]) for r in rows], "formula string, mean_ric double, fitness double, complexity int")


def sharpe_gate(mined: DataFrame, trials: int, top: int = 100, least: float = 0.75) -> DataFrame:
    """Of the best ``top``, those whose Sharpe ratio (about 16 mean RankICs) beats noise with chance ``least``."""
    from .overfit import expected_max_sharpe, normal_cdf

    days = max(trials, 60)
    sr = 16 * F.col("mean_ric")
    z = (sr - expected_max_sharpe(trials, days)) * math.sqrt(days)
    return mined.orderBy(F.desc("fitness"), "formula").limit(top).withColumn("p", normal_cdf(z)).where(F.col("p") >= least)


# Formulas that a leaf grows, the number of branches that the balance term refers to, the chance of a mutation.
GROWTH, BRANCHES, MUTATED = 4, 8, 0.5


class Branch:
    def __init__(self, tree: Node, parent: Branch | None = None):
        self.tree, self.parent, self.visits, self.total, self.children = tree, parent, 0, 0.0, []

    @property
    def value(self) -> float:
        return self.total / self.visits if self.visits else 0.0


@dataclass
class Root:
    """A search of its own: its random numbers, length budget, weight of exploration, and leaves put out in a round."""

    rng: random.Random
    budget: int = 15
    explore: float = 1.4
    leaves: int = 1
    branch: Branch = field(init=False)

    def __post_init__(self):
        self.branch = Branch(generate(self.rng, self.budget))

    def best(self) -> Branch:
        """The child of the root with most visits, then value; the root where it has none."""
        return max(self.branch.children, key=lambda c: (c.visits, c.value), default=self.branch)


def softmax_priors(children: list[Branch], bonus: dict[str, float]) -> list[float]:
    """Chances of the children: equal but for the frequency of their formulas among known good ones' subtrees."""
    most = max(bonus.values(), default=0.0) or 1.0
    raw = [math.exp(bonus.get(canonical(c.tree), 0.0) / most) for c in children]
    return [r / sum(raw) for r in raw]


def select_leaf(root: Root, bonus: dict[str, float]) -> Branch:
    """Down the branches of highest upper confidence to one without children, which grows; one of the grown is the leaf."""
    here = root.branch
    while here.children:
        total, balance = sum(c.visits for c in here.children), math.sqrt(len(here.children) / BRANCHES)
        chances = dict(zip(map(id, here.children), softmax_priors(here.children, bonus)))
        here = max(here.children, key=lambda c: c.value + root.explore * balance * chances[id(c)] * math.sqrt(total + 1) / (1 + c.visits))
    here.children = [Branch(mutate(root.rng, here.tree) if root.rng.random() < MUTATED else generate(root.rng, root.budget), here) for _ in range(GROWTH)]
    return root.rng.choice(here.children)


def prune(branch: Branch, least: int = 2) -> None:
    """Branches with fewer than ``least`` visits go where another has as many, and so on downwards; those that were never valued stay open."""
    if any(c.visits >= least for c in branch.children):
        branch.children = [c for c in branch.children if c.visits >= least or not c.visits]
    for c in branch.children:
        prune(c, least)


def path(branch: Branch | None) -> Iterator[Branch]:
    while branch is not None:
        yield branch
        branch = branch.parent


def grow(roots: list[Root], rounds: int, value: Callable[[list[Node]], list[float]], bonus: dict[str, float] | None = None, prune_every: int = 0) -> dict[str, float]:
    """Searches from all roots together; the values found, by canonical formula.

    In a round every root puts out its leaves one after another, each counted as a visit without value (a virtual loss)
    so that the next goes elsewhere. Then the formulas of all leaves that were not met before are valued in one call, that
    is one Spark job, and their values go up the paths. With one leaf a round a root's tree is that of a serial search.
    """
    known: dict[str, float] = {}
    for i in range(rounds):
        leaves: list[Branch] = []
        for k in range(max(r.leaves for r in roots)):
            for r in roots:
                if k < r.leaves:
                    leaf = select_leaf(r, bonus or {})
                    for b in path(leaf):
                        b.visits += 1
                    leaves.append(leaf)
        new = {c: leaf.tree for leaf in leaves if (c := canonical(leaf.tree)) not in known}
        if new:
            known.update(zip(new, value(list(new.values()))))
        for leaf in leaves:
            for b in path(leaf):
                b.total += known[canonical(leaf.tree)]
        if prune_every and (i + 1) % prune_every == 0:
            for r in roots:
                prune(r.branch)
    return known


def tree_search(rng: random.Random, iterations: int = 200, budget: int = 15, value: Callable[[list[Node]], list[float]] | None = None, explore: float = 1.4, bonus: dict[str, float] | None = None) -> Node:
    """One root, one leaf a round: the most visited child of the root."""
    root = Root(rng, budget, explore)
    grow([root], iterations, value or (lambda trees: [0.5] * len(trees)), bonus)
    return root.best().tree


def subtree_bonus(formulas: DataFrame, most: int = 10_000) -> dict[str, float]:
    """How often each subtree of two nodes or more stands in ``formulas(formula)``, of all their subtrees; the ``most`` frequent."""

    def run(batches):
        for b in batches:
            found = [canonical(n) for f in b["formula"] for n in parse(f).walk() if n.children]
            yield pd.DataFrame({"subtree": pd.Series(found, dtype=object)})

    counts = formulas.select("formula").distinct().mapInPandas(run, "subtree string").groupBy("subtree").count()
    top = counts.orderBy(F.desc("count"), "subtree").limit(most).collect()
    total = sum(r["count"] for r in top)
    return {r.subtree: r["count"] / total for r in top}


PLAN, PLANS = 12, 3  # formulas of one plan, whose making takes longer than in proportion; plans of a pool that run side by side


class PoolValues:
    """Values for ``grow``: the size of each formula's mean fold RankIC, ``least`` where it has none.

    A formula is scored once, however often it is asked for. ``jobs`` counts the scorings, ``rows`` holds what they found, by canonical formula.
    """

    def __init__(self, panel: DataFrame, least: float = 0.0, **folds):
        self.panel, self.least, self.folds, self.jobs, self.rows = panel, least, folds, 0, {}

    def score(self, pool: list[Node]) -> list:
        return score_pool(self.panel, pool, **self.folds).collect()

    def __call__(self, trees: list[Node]) -> list[float]:
        named = {c: t for t in trees if status_of(t) == "ok" and (c := canonical(t)) not in self.rows}
        if named:
            self.jobs += 1
            names, pool, plans = {str(t): c for c, t in named.items()}, list(named.values()), math.ceil(len(named) / PLAN)
            with ThreadPoolExecutor(min(PLANS, plans)) as side:
                # wrapped one by one: each has local properties of its own
                running = [side.submit(inheritable_thread_target(self.panel.sparkSession)(self.score), pool[i::plans]) for i in range(plans)]
                for r in running:
                    self.rows.update((names[row.formula], row) for row in r.result())
        return [abs(r.mean_ric) if (r := self.rows.get(canonical(t))) is not None and r.mean_ric is not None else self.least for t in trees]
