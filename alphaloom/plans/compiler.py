"""Formula pools compiled to one DataFrame plan: shared subtrees once, windows by ticker and by date in turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ewm_mean, full, last_rows, numbered, pct_rank, ts
from ..sources.catalog import keep as written
from .formula import Node, parse, status_of

_TINY = 1e-6


def finite(x: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(F.abs(x) < float("inf"), x)


def _both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


SCALAR: dict[str, Callable[..., Column]] = {
    "Abs": F.abs,
    "Sign": F.signum,
    "Log": lambda x: F.when(x > 0, F.ln(x)),
    "Add": lambda x, y: x + y,
    "Mul": lambda x, y: x * y,
    "Greater": lambda x, y: _both(x, y, F.greatest(x, y)),
    "Less": lambda x, y: _both(x, y, F.least(x, y)),
    "Div": lambda x, y: F.try_divide(x, F.signum(y) * F.greatest(F.abs(y), F.lit(_TINY))),
    "Pow": lambda x, y: finite(F.signum(x) * F.pow(F.greatest(F.abs(x), F.lit(_TINY)), y)),
    "Sub": lambda x, y: x - y,
}


def _window_rank(x: Column, w: int) -> Column:
    rows = F.collect_list(x).over(last_rows(w))
    below, equal = F.size(F.filter(rows, lambda v: v < x)), F.size(F.filter(rows, lambda v: v == x))
    return full(x, w, (below + (equal + 1) / 2.0) / w)


def _wma(x: Column, w: int) -> Column:
    rows = F.collect_list(x).over(last_rows(w))
    weighted = F.aggregate(F.transform(rows, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return full(x, w, weighted / (w * (w + 1) / 2.0))


def _mad(x: Column, w: int) -> Column:
    rows = F.collect_list(x).over(last_rows(w))
    mean = F.avg(x).over(last_rows(w))
    return full(x, w, F.aggregate(F.transform(rows, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / w)


def _moment(x: Column, w: int, k: int) -> Column:
    """Mean k-th power of the deviations in the window."""
    rows, mean = F.collect_list(x).over(last_rows(w)), F.avg(x).over(last_rows(w))
    return F.aggregate(F.transform(rows, lambda v: F.pow(v - mean, F.lit(float(k)))), F.lit(0.0), lambda a, v: a + v) / w


def _shape(x: Column, w: int, k: int) -> Column:
    """The k-th standardised moment; the aggregates of that name fail where a tiny variance's power is 0."""
    m2 = F.var_pop(x).over(last_rows(w))
    return F.try_divide(_moment(x, w, k), F.pow(m2, F.lit(k / 2.0)))


def _skew(x: Column, w: int) -> Column:
    if w < 3:
        return F.lit(None).cast("double")
    value = _shape(x, w, 3) * ((w * (w - 1)) ** 0.5 / (w - 2))
    constant = F.min(x).over(last_rows(w)) == F.max(x).over(last_rows(w))
    return full(x, w, F.when(constant, 0.0).otherwise(value))


def _kurt(x: Column, w: int) -> Column:
    if w < 4:
        return F.lit(None).cast("double")
    value = (w - 1) / ((w - 2) * (w - 3)) * ((w + 1) * (_shape(x, w, 4) - 3) + 6)
    constant = F.min(x).over(last_rows(w)) == F.max(x).over(last_rows(w))
    return full(x, w, F.when(constant, -3.0).otherwise(value))


def _framed(f: Callable[[Column], Column]) -> Callable[[Column, int], Column]:
    return lambda x, w: full(x, w, f(x).over(last_rows(w)))


ROLLING: dict[str, Callable[[Column, int], Column]] = {
    "Rank": _window_rank,
    "WMA": _wma,
    "EMA": lambda x, w: F.when(F.count(x).over(ts().rowsBetween(Window.unboundedPreceding, 0)) >= w, ewm_mean(x, w)),
    "Ref": lambda x, w: F.lag(x, w).over(ts()),
    "Mean": _framed(F.avg),
    "Sum": _framed(F.sum),
    "Std": _framed(F.stddev_samp),
    "Var": _framed(F.var_samp),
    "Skew": _skew,
    "Kurt": _kurt,
    "Max": _framed(F.max),
    "Min": _framed(F.min),
    "Med": _framed(lambda x: F.percentile(x, F.lit(0.5))),
    "Mad": _mad,
    "Delta": lambda x, w: x - F.lag(x, w).over(ts()),
}


def _paired(x: Column, y: Column, w: int, corr: bool) -> Column:
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    frame = last_rows(w)
    cov = F.covar_samp(a, b).over(frame)
    if corr:
        constant = (F.min(a).over(frame) == F.max(a).over(frame)) | (F.min(b).over(frame) == F.max(b).over(frame))
        cov = F.when(~constant, F.try_divide(cov, F.nullif(F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame), F.lit(0.0))))
    return full(a, w, cov)


PAIRED = {"Corr": lambda x, y, w: _paired(x, y, w, True), "Cov": lambda x, y, w: _paired(x, y, w, False)}
CROSS = {"CSRank": lambda x: pct_rank(x, "date")}


def register(name: str, kind: str, builder: Callable[..., Column]) -> None:
    """Adds an operator to the language: ``builder`` gets columns (and the window) and returns a column."""
    from . import formula

    {"unary": SCALAR, "binary": SCALAR, "binary_asym": SCALAR, "rolling": ROLLING, "paired_rolling": PAIRED, "cs_op": CROSS}[kind][name] = builder
    formula.KIND_OF[name] = kind
    if name not in formula.OPERATORS[kind]:
        formula.OPERATORS[kind] = (*formula.OPERATORS[kind], name)


_WINDOWED = ("rolling", "paired_rolling", "cs_op")


def _inner(n: Node) -> list[Node]:
    """The nearest windowed nodes below ``n``."""
    return [m for c in n.children for m in ([c] if c.kind in _WINDOWED else _inner(c))]


def _schedule(nodes: list[Node]) -> dict[tuple[int, int], list[Node]]:
    """Windowed nodes by (phase, step), in the order to evaluate them.

    Even phases hold windows by ticker, odd ones windows by date, so the panel is dealt anew once a phase, however deep
    windows of one kind nest; a node's step counts those of its own phase below it.
    """
    at: dict[Node, tuple[int, int]] = {}

    def place(n: Node) -> tuple[int, int]:
        if n not in at:
            below = [place(m) for m in _inner(n)]
            phase = max((p for p, _ in below), default=0)
            phase += phase % 2 != (n.kind == "cs_op")
            at[n] = phase, max((s + 1 for p, s in below if p == phase), default=0)
        return at[n]

    out: dict[tuple[int, int], list[Node]] = {}
    for n in nodes:
        out.setdefault(place(n), []).append(n)
    return dict(sorted(out.items()))


def evaluate(panel: DataFrame, pool: dict[str, str | Node], raw: bool = False) -> DataFrame:
    """``panel`` with a column for each formula of the pool, evaluated in one plan.

    ``panel`` has ticker, date and lower-case feature columns. Equal subtrees of all formulas are one column;
    windows by ticker and windows by date take turns, so the panel is shuffled once a turn. Unless ``raw``,
    missing values become 0 after evaluation and a formula that can never be evaluated is 0 throughout.
    """
    trees = {k: parse(f) if isinstance(f, str) else f for k, f in pool.items()}
    good = {k: t for k, t in trees.items() if status_of(t) == "ok"}
    base = panel.columns
    names: dict[Node, str] = {}
    for tree in good.values():
        for n in tree.walk():
            if n.kind in _WINDOWED and n not in names:
                names[n] = f"__w{len(names)}"

    def column(n: Node) -> Column:
        if n in names:
            return F.col(names[n])
        if n.kind == "feature":
            return F.col(n.op.lower())
        if n.kind in ("constant", "num"):
            return F.lit(float(n.op))
        return SCALAR[n.op](*map(column, n.children))

    def windowed(n: Node) -> Column:
        if n.kind == "cs_op":
            return CROSS[n.op](column(n.children[0]))
        *data, w = n.children
        return (ROLLING if n.kind == "rolling" else PAIRED)[n.op](*map(column, data), int(w.op))

    numbered_in = None
    for (phase, _), nodes in _schedule(list(names)).items():
        if phase != numbered_in and any(n.op == "EMA" for n in nodes):
            # a row's number is a window by ticker: after it, those by ticker and chunk need no shuffle of their own
            panel, numbered_in = numbered(panel), phase
        panel = panel.select("*", *[windowed(n).alias(names[n]) for n in nodes])
    out = []
    for k, t in trees.items():
        if k not in good:
            out.append(F.lit(0.0).alias(k))
        else:
            value = finite(column(t).cast("double"))
            out.append((value if raw else F.coalesce(value, F.lit(0.0))).alias(k))
    return panel.select(*base, *out)


def quantile_edges(rows: DataFrame, by: list[str], value: str, low: float, high: float, accuracy: int = 2_000) -> DataFrame:
    """(by, lo, hi): exact interpolated quantiles of each group, without a task that holds a group's values.

    Bounded sketches bracket the two quantiles; rows outside the brackets are only counted, those inside are
    counted by value, and a window over the few values inside finds the order statistics.
    """
    e = 2.0 / accuracy
    marks = [max(0.0, low - e), low + e, high - e, min(1.0, high + e)]
    rough = rows.groupBy(*by).agg(F.percentile_approx(value, marks, accuracy).alias("__b"), F.count(value).alias("__n")).where("__n > 0")
    v, b = F.col(value), F.col("__b")
    zone = F.when(v < b[0], 0).when(v <= b[1], 1).when(v < b[2], 2).when(v <= b[3], 3).otherwise(4)
    placed = rows.where(v.isNotNull()).join(F.broadcast(rough), by).select(*by, "__n", v.alias("__v"), zone.alias("__zone"))
    counted = placed.groupBy(*by, "__n", "__zone", F.when(F.col("__zone").isin(1, 3), F.col("__v")).alias("__at")).agg(F.count("*").alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    end = F.sum("__c").over(Window.partitionBy(*by).orderBy("__zone", "__at").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col("__c"))

    def order_statistic(k: Column) -> Column:
        inside = (F.col("__start") <= k) & (k < F.col("__end"))
        return F.max(F.when(inside, F.when(F.col("__start") == k, F.col("__min")).otherwise(F.col("__max"))))

    def quantile(q: float) -> Column:
        at = F.lit(q) * (F.max("__n") - 1)
        k = F.floor(at)
        return F.struct(at.alias("at"), k.alias("k"))

    spots = ranked.groupBy(*by).agg(quantile(low).alias("__lo"), quantile(high).alias("__hi"))
    j = ranked.join(F.broadcast(spots), by)
    found = j.groupBy(*by, "__lo", "__hi").agg(*[order_statistic(F.col(f"__{s}.k") + d).alias(f"__{s}{d}") for s in ("lo", "hi") for d in (0, 1)])
    value_of = lambda s: F.col(f"__{s}0") + F.coalesce(F.col(f"__{s}1") - F.col(f"__{s}0"), F.lit(0.0)) * (F.col(f"__{s}.at") - F.col(f"__{s}.k"))
    return found.select(*by, value_of("lo").alias("lo"), value_of("hi").alias("hi"))


def clip(signals: DataFrame, ids: list[str], low: float = 0.005, high: float = 0.995, by: Column | None = None) -> DataFrame:
    """Each signal clipped at its own quantiles over all rows, or over the rows of each value of ``by`` (a window).

    The quantiles are exact (``quantile_edges``); what is broadcast is one row per value of ``by``, with two numbers
    for each formula of the pool.
    """
    group = (F.lit(0) if by is None else by).alias("__g")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("v")) for k in ids]))
    stacked = signals.select(group, each.alias("__s")).select("__g", F.col("__s.f").alias("__f"), F.col("__s.v").alias("__x"))
    edges = quantile_edges(stacked, ["__g", "__f"], "__x", low, high)
    wide = edges.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("__f", F.struct("lo", "hi")))).alias("__q"))
    joined = signals.withColumn("__g", group).join(F.broadcast(wide), "__g")
    edge = lambda k, side: F.element_at("__q", F.lit(k))[side]
    return joined.select(*[c for c in signals.columns if c not in ids], *[F.least(F.greatest(F.col(k), edge(k, "lo")), edge(k, "hi")).alias(k) for k in ids])


def long(signals: DataFrame, ids: list[str], *keep: str) -> DataFrame:
    """(formula_id, ticker, date, signal, *keep): the pool stacked, so that statistics of all formulas share one aggregation."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("formula_id"), F.col(k).alias("signal")) for k in ids]))
    return signals.select("ticker", "date", *keep, rows.alias("s")).select("s.formula_id", "ticker", "date", "s.signal", *keep)


def filled(panel: DataFrame, pool: dict[str, str | Node], *keep: str) -> DataFrame:
    """Evaluated and filled, a column for each formula: written once (``catalog.keep``), as quantiles and what follows need several passes."""
    return written(evaluate(panel, pool).select("ticker", "date", *keep, *pool), "signals")


def signals(panel: DataFrame, pool: dict[str, str | Node], *keep: str, by: Column | None = None) -> DataFrame:
    """Evaluated, filled, clipped (in each window, where ``by`` names one) and stacked."""
    ids = list(pool)
    return long(clip(filled(panel, pool, *keep), ids, by=by), ids, *keep)


__all__ = ["evaluate", "clip", "filled", "long", "signals", "register"]
