"""Similar formulas of a pool by an inverted index of their paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.formula import Node, parse


def paths(node: Node, way: str = "") -> Iterator[str]:
    """The way from a subtree's root to each of its nodes, with the operators met; two subtrees share those along which they agree."""
    here = f"{way}/{node.kind}:{node.op}"
    yield here
    for i, c in enumerate(node.children):
        yield from paths(c, f"{here}.{i}")


def subtrees(formulas: DataFrame, threshold: float) -> DataFrame:
    """``(formula, size, node, paths)``: the subtrees large enough to be shared by the threshold, with their paths."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b["formula"]:
                tree = parse(text)
                rows += [(text, tree.size, i, list(paths(n))) for i, n in enumerate(tree.walk()) if n.size >= threshold * tree.size]
            yield pd.DataFrame(rows, columns=["formula", "size", "node", "paths"])

    return formulas.select("formula").where("formula is not null").distinct().mapInPandas(run, "formula string, size int, node int, paths array<string>")


def similar_pairs(formulas: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(formula_a, formula_b, similarity)`` for all pairs of different formulas, a before b, that are ``threshold`` similar or more.

    Similarity is ``plans.formula.similarity``: nodes of the largest subtrees that agree from their roots, over the larger
    formula's nodes. Subtrees agree in the paths that both have. To share ``threshold`` of a formula's nodes a subtree must
    have as many, and must share one of its rarest paths: all but that many less one. So only those paths of large
    subtrees are joined, and formulas of too different sizes not at all; what meets is compared exactly.
    """
    each = subtrees(formulas, threshold)
    least = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    long = each.select("formula", "size", "node", F.size("paths").alias("n"), F.explode("paths").alias("path"))
    counts = long.groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    ranked = long.join(counts, "path").groupBy("formula", "size", "node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "path"))).alias("p"))  # a formula's paths, a few dozen
    prefix = ranked.select("formula", "size", "node", F.explode(F.slice("p", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("e")).select("formula", "size", "node", F.col("e.path").alias("path"))
    a, b = (prefix.select("path", *[F.col(c).alias(f"{c}_{s}") for c in ("formula", "size", "node")]) for s in "ab")
    near = (F.col("formula_a") < F.col("formula_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
    met = a.join(b, "path").where(near).select("formula_a", "node_a", "formula_b", "node_b").distinct()
    whole = {s: each.select(F.col("formula").alias(f"formula_{s}"), F.col("node").alias(f"node_{s}"), F.col("size").alias(f"size_{s}"), F.col("paths").alias(f"paths_{s}")) for s in "ab"}
    j = met.join(whole["a"], ["formula_a", "node_a"]).join(whole["b"], ["formula_b", "node_b"])
    value = F.size(F.array_intersect("paths_a", "paths_b")) / F.greatest("size_a", "size_b")
    return j.groupBy("formula_a", "formula_b").agg(F.max(value).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
