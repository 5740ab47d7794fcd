"""A training corpus from raw documents: five stages, each applying one operator to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from alphaloom.llm.common import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose noisy-or over sentence scores reaches 0.5.

    Null and empty texts are one sentence without words and stay; rows may repeat; other columns than those of
    ``documents`` are not kept; without documents there are none.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id's, a null id behind all others.

    Near copies: sets of shingles of five words 0.8 alike or more, by count, among the candidates that SimHash
    fingerprints of 256 bits give. Groups are of texts: two rows of one id with different texts both stay. Null,
    empty and blank texts are one group.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes and more that an earlier document, or the document itself, has already.

    A character that a cut would take in part stays. Null texts stay null, rows and other ids as they are.
    """
    kept = F.col("kept").cast("string")
    out = suffix_dedup.remove_repeats(docs, whole_characters=True).withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark. Null, empty and very short texts have none; an empty benchmark drops nothing."""
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it. A null or empty text has no ids and decodes to an empty text."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded", release=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The stages train models and compare texts approximately; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
