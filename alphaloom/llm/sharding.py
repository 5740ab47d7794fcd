"""Balanced label propagation: linked rows move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch


def _of(values, key):
    """A literal lookup by shard number (there are few shards)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), key + 1)


def _ranked(rows: DataFrame, bucket, buckets: int, name: str) -> DataFrame:
    """``rows`` with each row's exact rank in its shard, by bucket and then uid, counted from 0.

    Rank = rows in the shard's earlier buckets + place in the own bucket, so that no task sorts a whole shard.
    """
    rows = rows.withColumn(f"{OWN}b", bucket)
    counts = rows.groupBy("shard", f"{OWN}b").agg(F.count("*").alias(f"{OWN}n"))
    before = F.sum(f"{OWN}n").over(Window.partitionBy("shard").orderBy(f"{OWN}b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", f"{OWN}b", F.coalesce(before, F.lit(0)).alias(f"{OWN}before"))
    place = F.row_number().over(Window.partitionBy("shard", f"{OWN}b").orderBy("uid")) - 1
    return rows.withColumn(f"{OWN}place", place).join(counts, ["shard", f"{OWN}b"]).withColumn(name, F.col(f"{OWN}before") + F.col(f"{OWN}place")).drop(f"{OWN}b", f"{OWN}before", f"{OWN}place")


def propagate(members: DataFrame, capacity: list[int], scratch: Scratch, buckets: int) -> DataFrame:
    """``members(uid, link, shard)``: rows of link classes with two rows or more -> the same with moved shards.

    In a round each class counts its rows per shard (a join and an aggregation, never its pairs); a row wants
    the shard with most of its class among those with room, if that beats its own; each shard lets in as many
    as it has room for, class by class. Every move raises the sum of squares of the classes' counts, so the rounds
    end: when no row moves. Rows without links take no room: they go wherever linked rows leave some.
    """
    shards = len(capacity)
    taste = F.xxhash64("link", "shard")  # settles ties differently for each class
    for i in count():
        held = {r.shard: r.n for r in members.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [max(0, capacity[s] - held.get(s, 0)) for s in range(shards)]
        counts = members.groupBy("link", "shard").agg(F.count("*").alias("c")).withColumn("own", F.struct("c", taste.alias("t")))
        best = counts.where(_of(room, F.col("shard")) > 0).groupBy("link").agg(F.max(F.struct("own", "shard")).alias("best"))
        wants = members.join(counts.select("link", "shard", "own"), ["link", "shard"]).join(best, "link", "left")
        wants = wants.select("uid", "link", "shard", F.when((F.col("best.shard") != F.col("shard")) & (F.col("best.own") > F.col("own")), F.col("best.shard")).alias("to"))
        wants = scratch.keep(wants, f"wants{i}")
        asked = {r.to: r.n for r in wants.where("to is not null").groupBy("to").agg(F.count("*").alias("n")).collect()}
        asks = wants.where("to is not null").select("uid", "link", F.col("to").alias("shard"))
        let_in = _ranked(asks, F.pmod(F.xxhash64("link", F.lit(i)), F.lit(buckets)), buckets, "rank").where(F.col("rank") < _of(room, F.col("shard")))
        after = wants.select("uid", "link", "shard").join(let_in.select("uid", F.col("shard").alias("to")), "uid", "left")
        members = scratch.keep(after.select("uid", "link", F.coalesce("to", "shard").alias("shard")), f"members{i}")
        moved = sum(min(asked.get(s, 0), room[s]) for s in range(shards))
        if i:
            scratch.drop(f"members{i - 1}")
        scratch.drop(f"wants{i}")
        if moved == 0:
            break
    return members


def fill(sizes: list[int], room: list[int]) -> list[tuple[int, int]]:
    """(rows, shard) pieces for classes of ``sizes`` in turn, each over as few shards as have room; takes from ``room``."""
    pieces = []
    for left in sizes:
        while left:
            s = min(range(len(room)), key=lambda k: (room[k] < left, room[k] if room[k] >= left else -room[k], k))
            pieces.append((min(left, room[s]), s))
            left -= pieces[-1][0]
            room[s] -= pieces[-1][0]
    return pieces


def balanced_shards(rows: DataFrame, link: list[str], shards: int = 24) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Law ``rows``: the shards' row counts differ by one at most. Rows that are equal in the columns ``link`` are
    linked with one another; shards are chosen to keep linked rows together. Rows start spread by hash, then
    linked rows propagate under quotas of the even share until none moves; at the end, shards over their share give
    away rows, those without links first, to shards under it. Classes larger than a shard's share (no more than
    there are shards) are placed before: each fills one shard after another. Nulls in ``link`` are equal to one another; repeated rows are rows of their
    own; an empty table stays empty. Columns named shard or slot are replaced, all others pass through.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    rows = rows.drop("shard", "slot")
    whole = scratch.keep(rows.withColumn(f"{OWN}uid", F.monotonically_increasing_id()).withColumn(f"{OWN}link", F.xxhash64(*link)), "rows")
    base = whole.select(F.col(f"{OWN}uid").alias("uid"), F.col(f"{OWN}link").alias("link"))
    total = base.count()
    exact = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(256, total // (shards * 50_000))
    spot = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(buckets))
    classes = scratch.keep(base.groupBy("link").agg(F.count("*").alias("n")).where("n > 1"), "classes")
    large = classes.where(F.col("n") > exact[0]).orderBy(F.desc("n"), "link").collect()
    room = list(exact)
    pieces = fill([r.n for r in large], room)
    free = [s for s in range(shards) if room[s]] or [0]
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = base.select("uid", "link").join(classes, "link", "left_semi")
    names = [r.link for r in large]
    small = linked.where(~F.col("link").isin(names)) if large else linked
    begin = _of(free, F.pmod(F.xxhash64("uid"), F.lit(len(free))).cast("int")).alias("shard")
    moved = propagate(scratch.keep(small.select("uid", "link", begin), "linked"), room, scratch, buckets).select("uid", F.col("shard").alias("to"), F.lit(1).alias("rank_of"))
    if large:
        number = F.coalesce(*[F.when(F.col("link") == x, F.lit(k)) for k, x in enumerate(names)])
        big = _ranked(linked.where(F.col("link").isin(names)).select("uid", number.alias("shard")), spot, buckets, "rank")
        place = F.col("rank") + _of([0, *accumulate(r.n for r in large)][:-1], F.col("shard"))
        ends = zip(accumulate(n for n, _ in pieces), (s for _, s in pieces))
        moved = moved.unionAll(big.select("uid", F.coalesce(*[F.when(place < e, F.lit(s)) for e, s in ends]).alias("to"), F.lit(2).alias("rank_of")))
    placed = base.select("uid", start.alias("start")).join(moved, "uid", "left").select("uid", F.coalesce("to", "start").alias("shard"), F.coalesce("rank_of", F.lit(0)).alias("linked"))
    placed = scratch.keep(placed, "placed")
    held = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = [max(0, held.get(s, 0) - exact[s]) for s in range(shards)]
    under = [max(0, exact[s] - held.get(s, 0)) for s in range(shards)]
    ranked = _ranked(placed, spot + F.col("linked") * buckets, buckets, "rank")
    gives = F.col("rank") < _of(over, F.col("shard"))
    number = F.col("rank") + _of([0, *accumulate(over)][:-1], F.col("shard"))  # among all rows given away
    edges = list(accumulate(under))
    to = F.coalesce(*[F.when(number < e, F.lit(s)) for s, e in enumerate(edges) if under[s]], F.lit(None).cast("int")) if any(under) else F.lit(None).cast("int")
    final = ranked.select("uid", F.when(gives, to).otherwise(F.col("shard")).cast("int").alias("shard"))
    final = scratch.keep(final, "final")
    slots = _ranked(final, spot, buckets, "slot").select("uid", "shard", F.col("slot").cast("bigint").alias("slot"))
    slots = slots.withColumnRenamed("uid", f"{OWN}uid")
    return whole.join(slots, f"{OWN}uid").drop(f"{OWN}uid", f"{OWN}link")
