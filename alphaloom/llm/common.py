"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name prefix of the operators' own columns, so that a caller's columns never clash with them.
OWN = "__llm_"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (single-machine tests) a temporary folder is taken, noted in the session and removed
    when this process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("alphaloom.shared.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        folder = tempfile.mkdtemp(prefix="alphaloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("alphaloom.shared.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage, in one folder of the shared directory.

    A lost executor then costs a reread of Parquet files, not the replay of an iteration's whole history.
    ``drop`` removes a table that nothing needs any more; what a returned DataFrame still reads stays, under
    a name that starts with the operator's, for the cluster's retention rule of the shared directory.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows that no model learns from: crc32(doc_id as text) mod 5 = 0 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checked_broadcast(small: DataFrame, rows: int = 500_000) -> DataFrame:
    """``small``, rows of a few numbers, with a broadcast hint where at most ``rows`` are counted (some 50 MB); beyond, as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most so many rows, where the session does not say otherwise: texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, for the executor's other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2 << 20, most_rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices bounded by rows and by the bytes of one column (a longer value is a slice of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def with_columns(docs: DataFrame, text: str, made: dict[str, str], run: Callable[[Iterator[tuple[pa.RecordBatch, pa.Array]]], Iterator[list[pa.Array]]]) -> DataFrame:
    """``docs`` with the columns ``made`` (name: DDL type) that ``run`` makes of slices (rows, their texts), in one pass.

    The text goes to Python once, whether the result keeps it or not. Columns named like the new ones are replaced
    (a text column so named is read before).
    """
    kept = [c for c in docs.columns if c not in made]
    whole = text in kept and docs.schema[text].dataType.simpleString() == "string"
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if whole else [F.col(f"`{text}`").cast("string").alias(f"{OWN}text")]))
    at = src.columns.index(text if whole else f"{OWN}text")

    def each(batches):
        for whole_batch in batches:
            for part in slices(whole_batch, at):
                yield part, part.column(at)

    def mapped(batches):
        parts: list[pa.RecordBatch] = []

        def noted():
            for part, texts in each(batches):
                parts.append(part)
                yield part, texts

        for columns in run(noted()):
            part = parts.pop()
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*kept, *made])
        give_back()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(kept)]), *(f"`{n}` {t}" for n, t in made.items())])
    return src.mapInArrow(mapped, schema)
