"""Hidden Markov models over many series at once, as an associative scan over chunks of dates.

The steps of a chunk multiply to one K x K product. Products are joined in the order of dates, in groups of bounded width
and in as many levels as the longest history needs, which gives each chunk what comes before and after it; a second
pass over the chunks then has every date's probabilities, or the sums that expectation-maximisation needs. No group
holds more than a chunk of a series. Where the table's dates are few enough for one chunk, nothing is carried, and a
pass is a map over the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import keep

DAYS, WIDTH = 1_024, 256  # of dates in a chunk, of chunks in a group
CELLS = 1 << 19  # of dates, gaps included, in the arrays of a pass
TINY = 1e-300


@dataclass
class Cut:
    """Series in chunks ``(key, chunk, dates, x)``, written; ``alone`` where each is the only one of its series."""

    chunks: DataFrame
    alone: bool


def spans(rows: DataFrame) -> tuple[int, int]:
    """``(origin, days)`` of chunks that hold ``DAYS`` of the table's dates at the most: one for all dates, if they are no more."""
    dates = rows.select(F.unix_date("date").alias("d")).where("d is not null").distinct()
    blocks = dates.groupBy(F.floor(F.col("d") / DAYS)).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    all_ = blocks.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if not all_.n:
        return 0, DAYS
    return (all_.low, all_.high - all_.low + 1) if all_.n <= DAYS else (0, DAYS * max(1, DAYS // all_.most))


def chunked(rows: DataFrame, names: list[str], key: str = "ticker", days: int = DAYS, origin: int = 0) -> DataFrame:
    """``(key, chunk, dates, x)``: each series cut at fixed dates, so that no window has to number its rows; ``x`` has a date's features side by side. Incomplete rows are left out."""
    x = F.array(*[F.col(n).cast("double") for n in names])
    whole = rows.na.drop(subset=[key, "date", *names]).select(F.col(key).alias("key"), F.floor((F.unix_date("date") - origin) / days).alias("chunk"), F.struct("date", x.alias("x")).alias("r"))
    grouped = whole.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return grouped.select("key", "chunk", F.col("r.date").alias("dates"), F.flatten("r.x").alias("x"))


def cut(rows: DataFrame, names: list[str], key: str = "ticker", days: int | None = None) -> Cut:
    """The chunks of ``rows``, of ``days`` days or as ``spans`` has it."""
    origin, days = (0, days) if days else spans(rows)
    chunks = keep(chunked(rows, names, key, days, origin), "chunks")
    ends = chunks.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).first()
    return Cut(chunks, ends.a == ends.b)


def _padded(x: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ``width`` values a date as one array (rows, longest, width), with their dates' numbers."""
    lengths = x.value_lengths().to_numpy(zero_copy_only=False).astype(int) // width
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.zeros((len(lengths), max(lengths, default=0), width))
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = values
    return out, lengths


def _sliced(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``at``, padded, has ``CELLS`` dates at the most (or one row)."""
    for b in batches:
        if b.num_rows:
            longest = max(1, max(b.column(at).value_lengths().to_numpy(zero_copy_only=False)) // width)
            rows = max(1, CELLS // longest)
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)


class Model:
    """A diagonal Gaussian model: ``pi``, ``a``, ``m`` and ``s`` (variances)."""

    def __init__(self, spec: dict):
        self.pi, self.a, self.m, self.s = (np.array(spec[n], float) for n in ("pi", "a", "m", "s"))
        self.k, self.d = len(self.pi), self.m.shape[-1]

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Densities over the largest of each row, and its logarithm."""
        logs = np.stack([-0.5 * ((x - m) ** 2 / s + np.log(2 * np.pi * s)).sum(axis=-1) for m, s in zip(self.m, self.s)], axis=-1)
        top = logs.max(axis=-1, keepdims=True)
        return np.exp(logs - top), top[..., 0]

    def product(self, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """diag(b1) A diag(b2) A ... of each chunk, up to a factor."""
        p = b[:, 0, :, None] * np.eye(self.k)
        for t in range(1, b.shape[1]):
            now = lengths > t
            step = (p[now] @ self.a) * b[now, t, None, :]
            p[now] = step / np.maximum(step.sum(axis=(1, 2), keepdims=True), TINY)
        return p

    def passes(self, b: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Filtered and backward probabilities, the scales, and what enters each chunk; ``before`` is NaN where a series begins."""
        enter = np.where(np.isnan(before), self.pi, before @ self.a)
        alpha, beta, scale = np.zeros_like(b), np.zeros_like(b), np.ones(b.shape[:2])
        now = enter
        for t in range(b.shape[1]):
            step = (now if t == 0 else now @ self.a) * b[:, t]
            total = np.maximum(step.sum(axis=1), TINY)
            on = lengths > t
            scale[on, t] = total[on]
            now = np.where(on[:, None], step / total[:, None], now)
            alpha[:, t] = now
        now = after
        for t in range(b.shape[1] - 1, -1, -1):
            last = lengths == t + 1
            if t + 1 < b.shape[1]:
                step = (b[:, t + 1] * now) @ self.a.T
                now = np.where((lengths > t + 1)[:, None], step / np.maximum(step.sum(axis=1, keepdims=True), TINY), now)
            now = np.where(last[:, None], after, now)
            beta[:, t] = now
        return alpha, beta, scale, enter


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(x.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x[0].size if len(x) else 0)), flat)


def products(chunks: DataFrame, models: list[dict]) -> DataFrame:
    """``(model, key, at, p)``: the product of each chunk under each model, in one pass over the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, 2, Model(models[0]).d):
            x, lengths = _padded(b.column(2), Model(models[0]).d)
            for i, spec in enumerate(models):
                m = Model(spec)
                e, _ = m.emissions(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), b.column(0), b.column(1), _lists(m.product(e, lengths))], names=["model", "key", "at", "p"])

    return chunks.select("key", "chunk", "x").mapInArrow(run, f"model int, key {chunks.schema['key'].dataType.simpleString()}, at bigint, p array<double>")


def _joined(models: list[dict]):
    """Groups of neighbouring products -> the product of each group."""

    def run(batches):
        for b in batches:
            out = []
            for i, p in zip(b.column(0).to_pylist(), b.column(3)):
                a, whole = np.array(models[i]["a"], float), None
                for one in p:
                    q = np.array(one.as_py()).reshape(a.shape)
                    whole = q if whole is None else whole @ a @ q
                    whole = whole / max(whole.sum(), TINY)
                out.append(whole.reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["model", "key", "at", "p"])

    return run


def _spread(models: list[dict]):
    """Groups of neighbouring products, and what comes before and after each -> the same for every product."""

    def run(batches):
        for b in batches:
            found = ([], [], [], [], [])
            for i, key, ats, ps, before, after in zip(*(c.to_pylist() for c in b.columns)):
                m = Model(models[i])
                p = [np.array(q).reshape(m.k, m.k) for q in ps]
                now, befores = None if before is None else np.array(before), []
                for q in p:
                    befores.append(None if now is None else now.tolist())
                    v = (m.pi if now is None else now @ m.a) @ q
                    now = v / max(v.sum(), TINY)
                now, afters = np.ones(m.k) if after is None else np.array(after), []
                for q in reversed(p):
                    afters.append(now.tolist())
                    v = m.a @ (q @ now)
                    now = v / max(v.sum(), TINY)
                for column, values in zip(found, ([i] * len(p), [key] * len(p), ats, befores, afters[::-1])):
                    column += values
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], b.column(1).type), pa.array(found[2], pa.int64()), pa.array(found[3], doubles), pa.array(found[4], doubles)], names=["model", "key", "at", "before", "after"])

    return run


def carries(each: DataFrame, models: list[dict], width: int = WIDTH) -> DataFrame:
    """``(model, key, at, before, after)``: for each chunk the filtered probabilities of the date before it (null where its series begins) and the backward ones of its last date.

    Series of more than ``width`` chunks go through joined products, ``width`` chunks each, one level above.
    """
    kind = each.schema["key"].dataType.simpleString()
    ends = each.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    deep = ends.a is not None and ends.b - ends.a >= width
    group = F.floor(F.col("at") / width) if deep else F.lit(0)
    groups = each.groupBy("model", "key", group.cast("bigint").alias("group")).agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("r")).select("model", "key", "group", F.col("r.at").alias("ats"), F.col("r.p").alias("ps"))
    if deep:
        groups = keep(groups, "products")
        above = carries(groups.select("model", "key", "group", "ps").mapInArrow(_joined(models), f"model int, key {kind}, at bigint, p array<double>"), models, width)
        groups = groups.join(above.withColumnRenamed("at", "group"), ["model", "key", "group"])
    else:
        groups = groups.withColumns({n: F.lit(None).cast("array<double>") for n in ("before", "after")})
    return groups.select("model", "key", "ats", "ps", "before", "after").mapInArrow(_spread(models), f"model int, key {kind}, at bigint, before array<double>, after array<double>")


def _with_carries(chunks: DataFrame, models: list[dict], width: int) -> DataFrame:
    found = carries(products(chunks, models), models, width)
    return chunks.join(found.withColumnRenamed("at", "chunk"), ["key", "chunk"]).select("model", "key", "dates", "x", "before", "after")


def _passes(spec: dict, x: pa.Array, before: pa.Array | None = None, after: pa.Array | None = None):
    """Rows of one model; without ``before`` and ``after`` each is a whole series."""
    m = Model(spec)
    values, lengths = _padded(x, m.d)
    e, top = m.emissions(values)
    enters = np.full((len(x), m.k), math.nan) if before is None else np.array([[math.nan] * m.k if v is None else v for v in before.to_pylist()])
    leaves = np.ones((len(x), m.k)) if after is None else np.array(after.to_pylist())
    return m, values, lengths, e, top, enters, m.passes(e, lengths, enters, leaves)


def probabilities(rows: DataFrame, names: list[str], model: dict, key: str = "ticker", days: int | None = None, width: int = WIDTH, made: Cut | None = None) -> DataFrame:
    """``(key, date, filtered, smoothed)``: state probabilities of every complete row given its series up to its date, and given all of it.

    Any number of series of any length; a series without complete rows does not appear. ``made``: the chunks of ``rows``, if they are there.
    """
    made = made or cut(rows, names, key, days)
    kind = made.chunks.schema["key"].dataType.simpleString()

    def run(batches):
        for b in _sliced(batches, 2, Model(model).d):
            _, _, lengths, _, _, _, (alpha, beta, _, _) = _passes(model, *b.columns[2:])
            both = alpha * beta
            both /= np.maximum(both.sum(axis=2, keepdims=True), TINY)
            there = np.arange(alpha.shape[1])[None] < lengths[:, None]
            of = np.repeat(np.arange(len(lengths)), lengths)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).flatten(), _lists(alpha[there]), _lists(both[there])], names=["key", "date", "filtered", "smoothed"])

    each = made.chunks.select("key", "dates", "x") if made.alone else _with_carries(made.chunks, [model], width).select("key", "dates", "x", "before", "after")
    return each.mapInArrow(run, f"key {kind}, date date, filtered array<double>, smoothed array<double>").withColumnRenamed("key", key)


def _summed(spec: dict, *columns: pa.Array) -> np.ndarray:
    """The sums of expectation-maximisation over rows of one model, in one array."""
    m, x, lengths, e, top, before, (alpha, beta, scale, _) = _passes(spec, *columns)
    there = np.arange(e.shape[1])[None] < lengths[:, None]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), TINY)
    gamma[~there] = 0
    # every step from one date to the next, those into a chunk included
    prior = np.concatenate([before[:, None], alpha[:, :-1]], axis=1)
    step = prior[:, :, :, None] * m.a * (e * beta)[:, :, None, :]
    step[~there | np.isnan(prior[:, :, 0])] = 0
    step /= np.maximum(step.sum(axis=(2, 3), keepdims=True), TINY)
    first = np.isnan(before[:, 0])
    states = np.bincount(gamma[there].argmax(axis=1), minlength=m.k)
    flat, g = x[there], gamma[there]
    likely = float((np.log(scale) + top)[there].sum())
    return np.concatenate([[len(flat), likely, first.sum()], states, gamma[first, 0].sum(axis=0), g.sum(axis=0), (g.T @ flat).ravel(), (g.T @ flat**2).ravel(), step.sum(axis=(0, 1)).ravel()])


def _sums(models: list[dict], alone: bool):
    """Whole series, or rows of all models -> for each model met in a task its sums."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for b in _sliced(batches, 0, Model(models[0]).d):
            numbers = None if alone else b.column(1).to_numpy(zero_copy_only=False)
            for i in range(len(models)) if alone else np.unique(numbers).tolist():
                columns = b.columns if alone else [c for j, c in enumerate(b.filter(pa.array(numbers == i)).columns) if j != 1]
                found[i] = found.get(i, 0) + _summed(models[i], *columns)
        for i, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), _lists(v[None])], names=["model", "sums"])

    return run


def start(rows: DataFrame, names: list[str], k: int) -> dict:
    """A model whose states are ranges of equal frequency of the first feature."""
    first = F.col(names[0])
    cuts = rows.agg(F.percentile_approx(first, [(j + 1) / k for j in range(k - 1)], 100_000).alias("q")).first().q or []
    state = sum((F.when(first > c, 1).otherwise(0) for c in cuts), F.lit(0))
    got = {r.state: r for r in rows.groupBy(state.alias("state")).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.var_pop(n).alias(f"s_{n}") for n in names]).collect()}
    some = next(iter(got.values()))
    of = lambda j, what: [float(got.get(j, some)[f"{what}_{n}"]) for n in names]
    return {"k": k, "pi": [1 / k] * k, "a": (np.full((k, k), 0.1 / k) + np.eye(k) * 0.9).tolist(), "m": [of(j, "m") for j in range(k)], "s": [[v + 1e-3 for v in of(j, "s")] for j in range(k)]}


def fit(rows: DataFrame, names: list[str], begin: list[dict], rounds: int = 60, key: str = "ticker", days: int | None = None, width: int = WIDTH, made: Cut | None = None) -> list[dict]:
    """Expectation-maximisation of all models of ``begin`` at once over all series; each gets its ``bic`` and ``least`` (rows of its rarest state).

    A round is one pass over the chunks for all models together: sums per task, then per model; only those sums, some
    K (K + 2 d) numbers a model, come to the driver. A model stops when its likelihood gains under 1e-4 a row.
    """
    made = made or cut(rows, names, key, days)
    models, last, open_ = [dict(m) for m in begin], [-math.inf] * len(begin), list(range(len(begin)))
    d = len(names)
    for _ in range(rounds):
        now = [models[i] for i in open_]
        each = made.chunks.select("x") if made.alone else _with_carries(made.chunks, now, width).select("x", "model", "before", "after")
        sums = each.mapInArrow(_sums(now, made.alone), "model int, sums array<double>")
        got: dict[int, list] = {}
        for r in sums.select("model", F.posexplode("sums")).groupBy("model", "pos").agg(F.sum("col").alias("v")).orderBy("model", "pos").collect():
            got.setdefault(open_[r.model], []).append(r.v)
        still = []
        for i in open_:
            v, k = np.array(got[i]), len(models[i]["pi"])
            n, likely, series = v[:3]
            states, pi, g, gx, gxx, steps = np.split(v[3:], np.cumsum([k, k, k, k * d, k * d]))
            gx, gxx, steps, w = gx.reshape(k, d), gxx.reshape(k, d), steps.reshape(k, k), np.maximum(g, 1e-12)[:, None]
            mean = gx / w
            free = k * k - 1 + k * d + k * d * (d + 1) // 2  # counted as for full covariances
            models[i] = {"k": k, "pi": (pi / series).tolist(), "a": (steps / np.maximum(steps.sum(axis=1), 1e-12)[:, None]).tolist(), "m": mean.tolist(), "s": np.maximum(gxx / w - mean**2, 1e-4).tolist(), "bic": float(-2 * likely + free * math.log(n)), "least": int(states.min())}
            if likely - last[i] >= 1e-4 * n:
                still.append(i)
            last[i] = likely
        open_ = still
        if not open_:
            break
    return models


def select(rows: DataFrame, names: list[str], ks=(2, 3, 4, 5, 6), least: int = 200, rounds: int = 60, key: str = "ticker", made: Cut | None = None) -> dict:
    """The fitted model of lowest BIC whose states all have ``least`` rows (else that of the fewest states). With ``made``, the chunks of ``rows``, these should be cheap to read."""
    rows = rows.na.drop(subset=[key, "date", *names]).select(key, "date", *names)
    rows = rows if made else keep(rows, "features")
    found = fit(rows, names, [start(rows, names, k) for k in ks], rounds, key, made=made)
    fine = [f for f in found if f["least"] >= least]
    return min(fine, key=lambda f: f["bic"]) if fine else min(found, key=lambda f: f["k"])
