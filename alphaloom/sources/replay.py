"""A replay store: samples for learning in an append-only log, the newest of them valid, drawn by a seeded hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog, Conflict

SAMPLE = "ast string, ic double, visits array<double>, at bigint"
_STORED = f"{SAMPLE}, batch bigint"


class ReplayStore:
    """``(ast, ic, visits, at)`` by numbered commits; the ``capacity`` newest by (batch, at, ast) are valid.

    An append writes its rows and takes the next commit number, whoever else appends; its number is the batch of its rows.
    Compaction commits the valid rows as they are, with their batches, and removes what came before.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = 10_000):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        self.log = CommitLog(spark, f"{self.path}/commits")

    def append(self, samples: DataFrame, attempts: int = 1_000) -> int:
        """Adds ``samples`` (any of the columns, ``ast`` at least; ``at`` orders a batch); the number of its batch."""
        kinds = dict(c.split(" ", 1) for c in _STORED.split(", "))
        txn = uuid.uuid4().hex
        samples.select(*[(F.col(c) if c in samples.columns and c != "batch" else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.parquet(f"{self.path}/data/{txn}")
        for _ in range(attempts):
            number = max(self.log.numbers(), default=0) + 1
            if self.log.create(number, {"txn": txn, "full": False}):
                return number
        raise Conflict(f"{attempts} times another writer was first")

    def _used(self) -> dict[int, dict]:
        """Commits from the last full one on."""
        out: dict[int, dict] = {}
        for n in reversed(self.log.numbers()):
            out[n] = self.log.read(n)
            if out[n]["full"]:
                break
        return out

    def read(self) -> DataFrame:
        """The valid rows with their batches."""
        used = self._used()
        if not used:
            return self.spark.createDataFrame([], _STORED)
        number = F.create_map(*[F.lit(x) for n, c in used.items() for x in (c["txn"], n)])
        rows = self.spark.read.schema(_STORED).parquet(*[f"{self.path}/data/{c['txn']}" for c in used.values()])
        txn = F.element_at(F.split(F.input_file_name(), "/"), -2)
        rows = rows.withColumn("batch", F.coalesce("batch", F.element_at(number, txn).cast("bigint")))
        # the capacity bounds what is sorted in the end: each task hands on its newest only
        return rows.orderBy(F.desc("batch"), F.desc("at"), F.desc("ast")).limit(self.capacity)

    def sample(self, n: int, seed: int) -> DataFrame:
        """``n`` valid rows at random: those of the least hashes of the seed and the row, the same however rows are partitioned."""
        place = F.md5(F.concat_ws(":", F.lit(str(seed)), "ast", F.col("batch").cast("string"), F.coalesce(F.col("at").cast("string"), F.lit(""))).cast("binary"))
        return self.read().withColumn("__place", place).orderBy("__place").limit(n).drop("__place")

    def compact(self) -> bool:
        """Commits the valid rows as a whole; False if others wrote meanwhile, and then nothing is changed."""
        used = self._used()
        last, txn = max(used, default=0), uuid.uuid4().hex
        self.read().write.parquet(f"{self.path}/data/{txn}")
        won = self.log.create(last + 1, {"txn": txn, "full": True})
        for gone in [c["txn"] for c in used.values()] if won else [txn]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{gone}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return won

    def export_json(self, path: str) -> None:
        """The valid rows as ``[ast, ic, visits]`` lists, one a line."""
        self.read().select(F.to_json(F.struct(F.lit(3).alias("version"), F.struct("ast", "ic", "visits").alias("sample"))).alias("value")).write.text(path)

    def import_json(self, path: str) -> int:
        """Appends what a JSON file ``{"version": 2 or 3, "data": [[ast, ic, visits], ...]}`` holds; entries without tree or number are left out."""
        raw = self.spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("version int, data array<array<string>>").json(path)
        each = raw.where("version in (2, 3)").select(F.posexplode("data").alias("at", "d"))
        rows = each.select(F.get("d", F.lit(0)).alias("ast"), F.get("d", F.lit(1)).try_cast("double").alias("ic"), F.from_json(F.get("d", F.lit(2)), "array<double>").alias("visits"), F.col("at").cast("bigint").alias("at"))
        return self.append(rows.where("ast is not null and ic is not null"))
