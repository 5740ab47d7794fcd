"""The subpackage's queries and their DuckDB SQL, one query per operator plus the pipeline."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, embedding_dedup, exact_dedup, importance, lm_score, quality, sharding, simhash, suffix_dedup, token_count, toxicity
from . import oracles as sql
from .common import held_out, read

QUERIES: dict = {}
ORACLE: dict = {}


def query(f=None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add(f) if f else add


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes cut from whole texts. A null text has 0 bytes and an empty remainder; ids order documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts, and what they decode to, as digests. A null or empty text has no ids; rows are as they are in the table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more inside labels. Null, zero and non-finite vectors, and those without a label, link with nothing and are kept."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``; documents with equal texts are linked, null and empty texts with one another."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("text_sha256"))
    out = sharding.balanced_shards(docs, ["text_sha256"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good; background: all. A null or empty text is its end alone; repeated rows count as often."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.score(docs, read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")


@query
def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole texts by their lines. A null, empty or blank text is one empty line and gets a score as well."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks alone: a row for each document and benchmark item found in it. Null, empty and very short texts have none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return out.select("doc_id", "leak.item_id", "leak.cosine", "leak.subsequence", "leak.answer")


@query
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts, however long. Null and empty texts have 0 bytes and 0 tokens."""
    out = token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and their groups. Null, empty and blank texts have fingerprint 0 and are one group."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts by their sentences. A null or empty text is one empty sentence and gets the lowest score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


@query(sql=sql.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language. A null language is ``und``, a null text empty; whole texts, repeated rows count again."""
    return collocations.mine(read(spark, sf_dir, "documents").select("lang", "text"))


@query(sql=sql.IMPORTANCE)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards the benchmark. Null and empty texts have no features, weight 0, and are never drawn; equal scores by id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, read(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query(sql=sql.EXACT_DEDUP)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts equal but for white space. Null texts are empty ones; a row for each row of the table, dropped ones too; very long texts are compared whole."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over ``documents``; null, empty and repeated rows as its stages say."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


if (whole := importlib.import_module("corpus_pipeline").ORACLE_SQL) is not None:
    ORACLE["pipeline"] = whole
