"""Exact dedup: groups by a 128-bit hash of the content, told apart by their bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, Scratch

#: White space that counts as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null as an empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content: Callable[[Column], Column] = normalised, hashed: Callable[[Column], Column] = digest) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the content compared); a row for each row.

    Rows are aggregated by hash and whole content, so the bytes themselves are compared, and copies meet in the task that
    reads them before anything is shuffled: a content travels once for each reading task, however many rows have
    it. What comes back to the rows is keyed by the hash alone, without contents; only for hashes under which
    different contents were found (none, as a rule) are contents joined as well.

    The row with the smallest id stays, null ids behind all others (``keep_id`` is null where a group has no other).
    ``kept`` says whether a row's id is its group's ``keep_id``: rows that repeat both id and content all say so. Null texts
    are empty ones, and blank texts are alike; a text of any length is compared whole. Columns named like the new
    ones are replaced, all others pass through; an empty table stays empty.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    scratch = Scratch(docs.sparkSession, "exact")
    id_, text_, hash_ = f"{OWN}id", f"{OWN}text", f"{OWN}hash"
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], F.col(f"`{doc_id}`").alias(id_), content(F.col(f"`{text}`")).alias(text_))
    src = src.withColumn(hash_, hashed(F.col(text_)))
    own = src.groupBy(hash_, text_).agg(F.min(id_).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = own.groupBy(hash_).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias(f"{OWN}contents"))
    found = scratch.keep(found.where(f"group_size > 1 or {OWN}contents > 1"), "groups")
    one = found.where(f"{OWN}contents = 1").drop(f"{OWN}contents")
    told = src.withColumn("text_sha256", F.sha2(F.col(text_).cast("binary"), 256))
    alone = [F.coalesce(F.col("keep_id"), F.when(F.col("group_size").isNull(), F.col(id_))).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size")]
    rest = [F.col(f"`{c}`") for c in src.columns if c not in (id_, text_, hash_)]
    if found.where(f"{OWN}contents > 1").isEmpty():
        out = told.drop(text_).join(one, hash_, "left")
    else:
        several = found.where(f"{OWN}contents > 1").select(hash_)
        exact = scratch.keep(own.join(several, hash_, "left_semi"), "contents")
        apart = told.join(several, hash_, "left_semi").join(exact, [hash_, text_], "left")
        out = told.join(several, hash_, "left_anti").drop(text_).join(one, hash_, "left").unionByName(apart.drop(text_))
    out = out.select(*rest, *alone, "text_sha256", id_)
    return out.withColumn("kept", F.col(id_).eqNullSafe(F.col("keep_id"))).drop(id_)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; rows that repeat both id and content stay together, as ``groups`` says."""
    marked = groups(docs.withColumns({f"{OWN}i": F.col(f"`{doc_id}`"), f"{OWN}t": F.col(f"`{text}`")}), f"{OWN}i", f"{OWN}t")
    return marked.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
