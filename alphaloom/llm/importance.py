"""Importance resampling towards a target: hashed n-gram weights, random noise by id, the highest scores drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import running_total
from .common import OWN, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: ASCII letters and digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def runs(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    each = [found]
    for n in range(2, longest + 1):  # no lambda refers to a whole array, so the optimiser can move none into a loop
        left = F.slice(each[-1], F.lit(1), F.greatest(F.size(each[-1]) - 1, F.lit(0)))
        right = F.slice(found, F.lit(n), F.greatest(F.size(found) - (n - 1), F.lit(0)))
        each.append(F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*each) if longest > 1 else found


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def counted(texts: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """``(bucket, n)`` over whole texts: at most ``buckets`` rows, added up in each task before the shuffle."""
    each = texts.select(F.explode(runs(words(F.col(f"`{text}`")), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with the array ``gains``: floor(1000 ln of the smoothed ratio of target to source) of each bucket, in their order."""
    spark: SparkSession = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    each = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("c"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = lambda t, all_s: (t + 1).cast("double") * (all_s + buckets).cast("double")
    gain = lambda c: F.floor(F.lit(1000.0) * F.log(up(c["t"], F.col("all_s")) / up(c["s"], F.col("all_t")))).cast("bigint")
    return each.select(F.transform("c", gain).alias("gains"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256 of ``seed:id``; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, longest: int = 1, buckets: int = 10_000, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score drawn; null: not drawn).

    Two passes over the texts: one counts the features of all documents by bucket, one adds up each document's gains by
    looking them up in one array of ``buckets`` numbers, which every task gets (80 kB for 10,000). Of the N documents with
    ``least_words`` words or more, floor(N * percent / 100) of the highest scores are drawn: the exact
    histogram of the integer scores is summed from the top (by ranges, so no task sorts it all), which gives each score
    the number of documents above it and so the last score that is drawn from; inside a score documents are numbered by id.

    Ties go to the smaller id, null ids last. Rows that repeat an id are rows of their own, with equal noise. A null
    or empty text has no features and weight 0, and is never drawn; an empty target leaves the gains to smoothing; an
    empty table stays empty. Texts of any length are counted whole. Columns named like the new ones are replaced.
    """
    made = ("n_features", "weight", "score", "rank")
    scratch = Scratch(docs.sparkSession, "importance")
    w, f, g, id_ = (f"{OWN}{x}" for x in ("words", "features", "gains", "id"))
    table = scratch.keep(gains(counted(docs, text, longest, buckets), counted(target, target_text, longest, buckets), buckets), "gains")
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], F.col(f"`{doc_id}`").alias(id_), words(F.col(f"`{text}`")).alias(w))
    src = src.withColumn(f, F.transform(runs(F.col(w), longest), lambda x: bucket(x, buckets))).withColumn(g, table.scalar())
    weight = F.aggregate(f, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(F.col(g), b))
    scored = src.select(*[F.col(f"`{c}`") for c in src.columns if c not in (w, f, g)], (F.size(w) >= least_words).alias(f"{OWN}able"), F.size(f).cast("bigint").alias("n_features"), weight.alias("weight"))
    scored = scratch.keep(scored.withColumn("score", F.col("weight") + noise(F.col(id_), seed)), "scored")
    able = scored.where(f"{OWN}able")
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    draw = able.count() * percent // 100
    above = scratch.keep(running_total(counts, [F.desc("score")], F.col("n"), f"{OWN}above", lambda df: scratch.keep(df, "histogram")).where(F.col(f"{OWN}above") < draw), "above")
    cutoff = above.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint")).drop(f"{OWN}able", id_)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(id_)))
    drawn = able.where(F.col("score") >= cutoff).withColumn("rank", within).join(above.select("score", f"{OWN}above"), "score")
    rank = F.col(f"{OWN}above") + F.col("rank")
    drawn = drawn.withColumn("rank", F.when(rank <= draw, rank).cast("bigint")).drop(f"{OWN}above")
    rest = scored.where(f"not {OWN}able or score < {cutoff}").withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).drop(f"{OWN}able", id_)
