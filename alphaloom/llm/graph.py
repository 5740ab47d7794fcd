"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(src, dst)`` (longs, any direction, repeats and self-links allowed) -> ``(node, component)``.

    ``component`` is the smallest node reachable; nodes without a link to another node do not appear. Every
    round is two aggregations and two joins on node ids; hubs are met by partial aggregation and by joins
    whose skewed side Spark may split. Rounds go on until nothing changes; their number grows with the logarithm
    of the longest chain.
    Null ends are ignored; an empty input gives an empty output.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst")
    now = scratch.keep(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links0")
    before = None
    for i in count():
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's lower neighbours, and the node itself, go to the lowest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.where("u <> v").distinct(), f"links{i + 1}")
        scratch.drop(f"links{i}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
