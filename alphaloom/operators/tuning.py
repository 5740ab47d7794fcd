"""Tuning of the search's parameters: Parzen-density proposals and successive halving over date slices."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ic, regime, search


@dataclass(frozen=True)
class Range:
    """A parameter's range; on a logarithmic scale, or of whole numbers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inside(self, u: float) -> float:
        """The value at share ``u`` of the range."""
        u = min(1.0, max(0.0, u))
        v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return int(round(v)) if self.whole else v

    def share(self, v: float) -> float:
        return math.log(v / self.low) / math.log(self.high / self.low) if self.log else (v - self.low) / (self.high - self.low)


# The parameters of mining and their ranges.
SPACE = {
    "max_K": Range(8, 20, whole=True),
    "c_puct": Range(0.5, 3.0),
    "mcts_rollouts": Range(8, 32, whole=True),
    "lambda_std": Range(0.5, 4.0),
    "lambda_cx": Range(0.001, 0.01, log=True),
    "temperature": Range(0.5, 5.0),
}
FAILED = -1e6


def _density(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean of normal densities around ``at`` on the unit interval, with one wide one for what was never tried."""
    width = max(0.05, 1.0 / (1 + len(at)) ** 0.5)
    each = np.exp(-0.5 * ((x[:, None] - at) / width) ** 2) / width if len(at) else np.zeros((len(x), 0))
    return (each.sum(axis=1) + 1.0) / (len(at) + 1)


def propose(rng: np.random.Generator, done: list[tuple[dict, float]], n: int, space: dict[str, Range] = SPACE, first: int = 5, good: float = 0.25, draws: int = 24) -> list[dict]:
    """``n`` parameter sets: by chance while fewer than ``first`` are done, else where good results are dense and bad ones are not.

    Each parameter is drawn on its own from the densities around the best quarter's values; of ``draws`` the one whose ratio
    of good to bad density is highest. What was proposed before in the same call counts as bad, so the sets differ.
    """
    ranked = sorted((d for d in done if math.isfinite(d[1])), key=lambda d: -d[1])
    out: list[dict] = []
    for _ in range(n):
        if len(ranked) < first:
            out.append({k: r.inside(rng.random()) for k, r in space.items()})
            continue
        cut = max(1, math.ceil(good * len(ranked)))
        best, rest = [d[0] for d in ranked[:cut]], [d[0] for d in ranked[cut:]] + out
        p = {}
        for k, r in space.items():
            g, b = (np.array([r.share(d[k]) for d in side]) for side in (best, rest))
            width = max(0.05, 1.0 / (1 + len(g)) ** 0.5)
            x = np.clip(np.where(rng.random(draws) < 1 / (len(g) + 1), rng.random(draws), g[rng.integers(len(g), size=draws)] + width * rng.standard_normal(draws)), 0, 1)
            p[k] = r.inside(float(x[np.argmax(_density(g, x) / _density(b, x))]))
        out.append(p)
    return out


def halving(run: Callable[[list[dict], int], list[float]], trials: list[dict], rungs: int, keep: float = 0.5) -> list[tuple[dict, float, int]]:
    """All trials on the smallest slice, the best share of them on the next larger one, and so on: (parameters, last value, rungs seen).

    ``run(parameters of all trials of a rung, rung)`` values a rung's trials together.
    """
    out, now = [], list(trials)
    for rung in range(rungs):
        values = run(now, rung)
        order = sorted(range(len(now)), key=lambda i: (-values[i], i))
        stay = order[: max(1, math.ceil(keep * len(now)))] if rung + 1 < rungs else []
        out += [(now[i], values[i], rung + 1) for i in order if i not in stay]
        now = [now[i] for i in stay]
    return out


def slices(days: list, rungs: int) -> list[tuple]:
    """(first, last) dates of ``rungs`` slices that end on the last day, each twice as long as the one before, the last whole."""
    return [(days[len(days) - max(1, len(days) >> (rungs - 1 - k))], days[-1]) for k in range(rungs)]


def pool_objective(mined: list[float], top: int = 10, least: int = 5) -> float:
    """Median of the best mean RankICs; too few results count as failure."""
    return median(sorted(mined, reverse=True)[:top]) if len(mined) >= least else FAILED


def fold_weights(similarity: dict[int, float], temperature: float, low: float = 0.1, high: float = 1.0) -> dict[int, float]:
    """Weights of folds by how alike their regime is to the latest, as ``regime.regime_weights`` has them for days."""
    return {k: low + (high - low) * math.exp(temperature * (s - 1)) for k, s in similarity.items()}


def trial_value(rows: list, p: dict, similarity: dict[int, float]) -> float:
    """What a trial's formulas are worth under its penalties and weights: the best by fitness, and of their RankICs the median."""
    weight = fold_weights(similarity, p["temperature"]) if similarity else {}
    found = []
    for r in rows:
        folds = [(f.fold, f.ric) for f in r.fold_rics or [] if f.ric is not None]
        if r.status != "ok" or not folds:
            continue
        w = [weight.get(k, 1.0) for k, _ in folds]
        mean = sum(a * ric for a, (_, ric) in zip(w, folds)) / sum(w)
        fit = mean - p["lambda_std"] * r.std_ric - p["lambda_cx"] * r.complexity - 0.5 * max(0.0, abs(r.size_corr or 0.0) - 0.3)
        found.append((-fit, r.formula, mean))
    return pool_objective([m for _, _, m in sorted(found)[:10]])


def run_trials(panel: DataFrame, params: list[dict], seed: int, rounds: int, similarity: dict[int, float] | None = None, value: search.PoolValues | None = None, **folds) -> tuple[list[float], int]:
    """The values of trials, each a tree search with its own length, exploration and leaves; all searches grow together, a round is one scoring.

    Returns the values and the number of scorings. All ``mcts_rollouts`` leaves are dealt over the rounds, evenly. ``value`` may
    have scored formulas of other trials on the same panel, which are not scored again.
    """
    roots = [search.Root(random.Random(seed), p["max_K"], p["c_puct"]) for p in params]
    value = value or search.PoolValues(panel, **folds)
    before = value.jobs
    for i in range(rounds):
        for r, p in zip(roots, params):
            r.leaves = p["mcts_rollouts"] * (i + 1) // rounds - p["mcts_rollouts"] * i // rounds
        search.grow(roots, 1, value)
    met = []
    for r in roots:
        stack, names = [r.branch], set()
        while stack:
            b = stack.pop()
            stack += b.children
            if b.visits and b is not r.branch:
                names.add(search.canonical(b.tree))
        met.append([value.rows[n] for n in sorted(names) if n in value.rows])
    return [trial_value(m, p, similarity or {}) for m, p in zip(met, params)], value.jobs - before


def tune(panel: DataFrame, days: list, batches: int = 5, n: int = 10, rungs: int = 1, rounds: int = 2, seed: int = 42, probs: DataFrame | None = None, space: dict[str, Range] = SPACE, **folds) -> dict:
    """The best parameters over one span of dates: ``{"params", "value", "jobs", "trials"}``.

    Batches of ``n`` proposals, each tried on the whole span. With more than one rung they go through successive halving
    instead, and only values of the whole span are compared at the end. A rung's formulas are scored once for all batches.
    """
    rng, done, finals, jobs = np.random.default_rng(seed), [], [], 0
    parts, made = slices(days, rungs), {}

    def rung_of(rung: int) -> tuple[DataFrame, search.PoolValues, dict[int, float]]:
        if rung not in made:
            a, b = parts[rung]
            some = panel.where(F.col("date").between(F.lit(a), F.lit(b)))
            span = [d for d in days if a <= d <= b]
            cut = ic.folds(span, folds.get("n_folds", 4), folds.get("embargo", 1), folds.get("least_days", 10))
            like = regime.fold_similarity(probs.where(F.col("date").between(F.lit(a), F.lit(b))), cut) if probs is not None else {}
            made[rung] = some, search.PoolValues(some, **folds), like
        return made[rung]

    def run(params: list[dict], rung: int) -> list[float]:
        nonlocal jobs
        some, value, like = rung_of(rung)
        values, used = run_trials(some, params, seed, rounds, like, value, **folds)
        jobs += used
        return values

    for _ in range(batches):
        found = halving(run, propose(rng, done, n, space), rungs)
        done += [(p, v) for p, v, _ in found]
        finals += [(p, v) for p, v, seen in found if seen == rungs]
    best = max(finals, key=lambda f: f[1])
    return {"params": best[0], "value": best[1], "jobs": jobs, "trials": len(done)}


def windows(days: list, n: int, length: int) -> list[list]:
    """``n`` spans of ``length`` days, the last at the end, the others shifted back evenly; spans overlap where days are few."""
    if len(days) < length:
        raise ValueError(f"{len(days)} days are fewer than the {length} of a window")
    step = max(1, (len(days) - length) // max(1, n - 1))
    return [span for i in range(n) if len(span := days[max(0, len(days) - i * step - length) : len(days) - i * step]) >= 2]


def consensus(params: list[dict]) -> dict:
    """The median of each parameter over the windows' results; whole numbers stay whole."""
    return {k: int(median(p[k] for p in params)) if all(isinstance(p[k], int) for p in params) else median(float(p[k]) for p in params) for k in params[0]}


def rolling_tune(panel: DataFrame, days: list, n_windows: int = 3, length: int = 252, seed: int = 42, **how) -> dict:
    """``tune`` on overlapping windows, which run side by side: their results, the parameters' medians and the window of the highest value."""
    spans = windows(days, n_windows, length)
    with ThreadPoolExecutor(len(spans)) as side:
        running = [side.submit(inheritable_thread_target(panel.sparkSession)(tune), panel, span, seed=seed + i, **how) for i, span in enumerate(spans)]
        found = [r.result() for r in running]
    return {"windows": found, "consensus": consensus([f["params"] for f in found]), "best": max(range(len(found)), key=lambda i: found[i]["value"])}
