"""Panels from a folder with a file for each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import dedupe, with_typical

# The columns of a symbol's file, and the panel's names for them.
COLUMNS = {"Date": "date", "Open": "popen", "High": "phigh", "Low": "plow", "Close": "pclose", "Volume": "vlot"}


def read_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all files ``<symbol>.csv`` (or folders ``symbol=<symbol>``) of a folder, by Spark's own reader: it plans small files together and prunes columns."""
    kinds = ", ".join(f"{c} {'date' if c == 'Date' else 'double'}" for c in COLUMNS)
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").schema(kinds).csv(folder)
    name = F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), "symbol=([^/]+)/", 1), F.lit("")), F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv[^/]*$", 1))
    return raw.select(F.url_decode(name).alias("ticker"), *[F.col(c).alias(n) for c, n in COLUMNS.items()])


def build_panel(spark: SparkSession, folder: str, symbols: DataFrame, shares: DataFrame | None = None, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """The panel of ``symbols(ticker)`` and the missing ones ``(ticker, reason)``.

    A symbol without a file, or with fewer than ``least`` dated rows, is missing (``empty_or_short``). Of rows of one
    ticker and date the first by price and volume stays. ``shares(ticker, shares_outstanding)``: null where unknown.
    """
    rows = read_symbols(spark, folder).where("date is not null").join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    counts = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.where(F.col("n") >= least).select("ticker")
    missing = symbols.select("ticker").distinct().join(enough, "ticker", "left_anti").withColumn("reason", F.lit("empty_or_short"))
    order = F.struct("popen", "phigh", "plow", "pclose", "vlot")
    panel = with_typical(dedupe(rows.join(enough, "ticker", "left_semi"), ["ticker", "date"], order))
    known = shares.groupBy("ticker").agg(F.max("shares_outstanding").alias("shares_outstanding")) if shares is not None else None
    return (panel.join(known, "ticker", "left") if known is not None else panel.withColumn("shares_outstanding", F.lit(None).cast("double"))), missing
