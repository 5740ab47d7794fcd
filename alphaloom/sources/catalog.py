"""The formula catalogue, trade ledgers and replay samples as files that Spark reads and appends."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .commits import CommitLog, Conflict

#: Version of the records that are written.
VERSION = 5

CATALOG = """formula string, ast string, ast_schema int, ic double, rank_ic double, adj_ic double, source string,
discovered_at string, updated_at string, split_date string, max_k int, population int, mcts_iters int, complexity int,
wf struct<mean_ric:double,std_ric:double,pos_folds:int,n_folds:int,fitness:double,fold_rics:array<double>,size_corr:double>,
overfit struct<train_ric:double,test_ric:double,degradation_pct:double,ic_drop_pct:double,verdict:string>,
backtests map<string,struct<net_return:double,ir:double,mdd:double,annual:double,at:string>>,
regime_champion_for int, live boolean, deactivated_at string, _schema int"""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on one machine without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("alphaloom.core.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="alphaloom-core-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("alphaloom.core.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several passes need is made once, and its lineage ends here.

    A lost executor then costs a reread. The files are removed when the driver's process ends.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Removes the files that ``keep`` wrote, once nothing is going to read them."""
    spark = kept.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of records of any version (or files with a record a line); what older ones lack takes its default. A broken file is an error."""
    return migrated(spark.read.schema(CATALOG).option("multiLine", not lines).option("mode", "FAILFAST").json(path))


def migrated(raw: DataFrame) -> DataFrame:
    """Records of versions 1 (which do not say so) to 5 as the newest version.

    Before 2 there is no adjusted RankIC: the size of the RankIC stands for it. Before 5 there is no version of the
    tree's form: it is the first. What came with 3 and 4 (walk-forward block, its fold values and size correlation, the
    fall of the IC) is null where a record lacks it.
    """
    version = F.coalesce("_schema", F.lit(1))
    given = {
        "adj_ic": F.when(version < 2, F.coalesce("adj_ic", F.abs(F.coalesce("rank_ic", F.lit(0.0))))).otherwise(F.col("adj_ic")),
        "ast_schema": F.when(version < 5, F.coalesce("ast_schema", F.lit(1))).otherwise(F.col("ast_schema")),
        "source": F.coalesce("source", F.lit("unknown")),
        "live": F.coalesce("live", F.lit(True)),
        "backtests": F.coalesce("backtests", F.create_map().cast(raw.schema["backtests"].dataType)),
    }
    return raw.withColumns(given).withColumn("_schema", F.lit(VERSION))


def latest(versions: DataFrame, key: str = "formula", at: str = "updated_at") -> DataFrame:
    """The newest version of each record of an append-only table."""
    others = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*others), F.col(at)).alias("__row"))
    return best.select(key, "__row.*").select(*versions.columns)


def ranked(catalog: DataFrame) -> DataFrame:
    """Walk-forward fitness first, records without it after, by the size of their RankIC."""
    fit = F.col("wf.fitness")
    return catalog.orderBy(F.desc(fit.isNotNull()), F.desc(F.coalesce(fit, F.abs("rank_ic"))), "formula")


def champions(catalog: DataFrame) -> DataFrame:
    """One active champion per regime, with the expected mean and deviation of its daily result."""
    live = catalog.where("live and regime_champion_for is not null")
    w = Window.partitionBy("regime_champion_for").orderBy(F.desc(F.coalesce("wf.fitness", "rank_ic")), "formula")
    best = live.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return best.withColumn("mean", F.coalesce("wf.mean_ric", "rank_ic", F.lit(0.0))).withColumn("std", F.coalesce("wf.std_ric", F.lit(0.05)))


def promote(catalog: DataFrame, probabilities: dict[int, float], top: int = 5) -> DataFrame:
    """The formula with the largest RankIC x probability of its regime among the best of the catalogue."""
    best = ranked(catalog).limit(top)
    p = F.coalesce(*[F.when(F.col("regime_champion_for") == k, F.lit(v)) for k, v in probabilities.items()], F.lit(0.0))
    return best.orderBy(F.desc(F.col("rank_ic") * p), "formula").limit(1)


def flatten(catalog: DataFrame) -> DataFrame:
    """Nested records to plain columns, names joined by an underscore; maps and arrays as JSON text."""
    out = []
    for f in catalog.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            out += [(F.to_json(F.col(f"{f.name}.{g.name}")) if g.dataType.typeName() in ("array", "map") else F.col(f"{f.name}.{g.name}")).alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.to_json(f.name).alias(f.name) if kind in ("array", "map") else F.col(f.name))
    return catalog.select(*out)


class Catalog:
    """The formula catalogue in a folder: records by formula, changed by numbered commits.

    A change is a function of the records valid before it. Its rows are written as Parquet that nothing refers to yet,
    checked, and made valid by taking the next commit number; if another writer took that number first, the change is made
    again on what is valid then, so no writer undoes another's work. Readers see whole commits only, and any number back.
    Every tenth commit holds all valid records, so a reader opens ten folders at most.
    """

    def __init__(self, spark: SparkSession, path: str, full_every: int = 10):
        self.spark, self.path, self.full_every = spark, path.rstrip("/"), full_every
        self.log = CommitLog(spark, f"{self.path}/commits")

    def read(self, number: int | None = None) -> DataFrame:
        """One record per formula, as of a commit (default: the last)."""
        schema = StructType([*self.spark.createDataFrame([], CATALOG).schema.fields, StructField("txn", StringType())])
        there = [n for n in self.log.numbers() if number is None or n <= number]
        used: dict[str, int] = {}
        for n in reversed(there):
            commit = self.log.read(n)
            used[commit["txn"]] = n
            if commit["full"]:
                break
        if not used:
            return self.spark.createDataFrame([], schema).drop("txn")
        seq = F.element_at(F.create_map(*[F.lit(x) for pair in used.items() for x in pair]), F.col("txn"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{t}" for t in used])
        return latest(rows.withColumn("seq", seq).drop("txn"), at="seq").drop("seq")

    def transact(self, change: Callable[[DataFrame], DataFrame], full: bool = False, attempts: int = 50) -> int:
        """Puts the whole records that ``change`` makes of the valid ones; the number of the commit.

        A batch with a formula twice, or after which a regime has two live champions, is an error and changes nothing.
        """
        for _ in range(attempts):
            last = max(self.log.numbers(), default=0)
            before = self.read(last)
            txn = uuid.uuid4().hex
            data = f"{self.path}/data/{txn}"
            change(before).select(*before.columns).withColumn("txn", F.lit(txn)).write.parquet(data)
            rows = self.spark.read.schema(before.schema).parquet(data)
            try:
                self._check(before, rows)
            except ValueError:
                self._delete(data)
                raise
            if self.log.create(last + 1, {"txn": txn, "full": full, "rows": rows.count()}):
                if not full and (last + 1) % self.full_every == 0:
                    self.compact()
                return last + 1
            self._delete(data)
        raise Conflict(f"{attempts} times another writer was first")

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    @staticmethod
    def _check(before: DataFrame, rows: DataFrame) -> None:
        twice = [r.formula for r in rows.groupBy("formula").count().where("count > 1 or formula is null").limit(5).collect()]
        if twice:
            raise ValueError(f"a formula may stand in a batch once only: {twice}")
        after = before.join(rows.select("formula"), "formula", "left_anti").select("regime_champion_for", "live").unionByName(rows.select("regime_champion_for", "live"))
        many = [r.regime_champion_for for r in after.where("live and regime_champion_for is not null").groupBy("regime_champion_for").count().where("count > 1").limit(5).collect()]
        if many:
            raise ValueError(f"a regime has one champion only: {many}")

    def compact(self) -> int:
        """A commit of all valid records, from which readers start."""
        return self.transact(lambda before: before, full=True)

    def upsert(self, rows: DataFrame) -> int:
        """New values of the records in ``rows`` (any of the catalogue's columns; what they lack, or have as null, is kept from before)."""

        def change(before: DataFrame) -> DataFrame:
            columns = [c for c in before.columns if c != "formula"]
            j = rows.select("formula", *[F.col(c).alias(f"__{c}") for c in rows.columns if c != "formula"]).join(before, "formula", "left")
            value = {c: F.coalesce(F.col(f"__{c}").cast(before.schema[c].dataType), F.col(c)) if c in rows.columns else F.col(c) for c in columns}
            value |= {"live": F.coalesce(value["live"], F.lit(True)), "source": F.coalesce(value["source"], F.lit("unknown")), "_schema": F.lit(VERSION)}
            return j.select("formula", *[v.alias(c) for c, v in value.items()])

        return self.transact(change)

    def import_json(self, path: str, lines: bool = False) -> int:
        """Records of JSON files of any version."""
        return self.upsert(read_catalog(self.spark, path, lines))

    def crown(self, regime: int, formula: str, at: str) -> int:
        """``formula`` (a known one that is live, else an error) becomes the regime's one champion; who was it before is not any more."""

        def change(before: DataFrame) -> DataFrame:
            new = before.where((F.col("formula") == formula) & F.col("live"))
            if new.isEmpty():
                raise ValueError(f"no live record of {formula}")
            old = before.where((F.col("regime_champion_for") == regime) & (F.col("formula") != formula)).withColumn("regime_champion_for", F.lit(None).cast("int"))
            return new.withColumns({"regime_champion_for": F.lit(regime), "updated_at": F.lit(at)}).unionByName(old)

        return self.transact(change)

    def deactivate(self, formulas: DataFrame, at: str) -> int:
        """The named formulas are no longer live, nor champions, from ``at`` on; unknown names change nothing."""
        off = {"live": F.lit(False), "deactivated_at": F.lit(at), "updated_at": F.lit(at), "regime_champion_for": F.lit(None).cast("int")}
        return self.transact(lambda before: before.join(formulas.select("formula").distinct(), "formula", "left_semi").withColumns(off))

    def snapshot(self, day: str, keep: int = 7) -> None:
        """The valid records as they are, once a day; the oldest beyond ``keep`` go."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
        if f"day={day}" in there:
            return
        self.read().write.parquet(f"{self.path}/snapshots/day={day}")
        for name in sorted([*there, f"day={day}"])[:-keep]:
            self._delete(f"{self.path}/snapshots/{name}")

    def export(self, path: str) -> None:
        """The valid records as CSV with plain columns."""
        flatten(self.read()).write.mode("overwrite").option("header", True).csv(path)


def append(rows: DataFrame, path: str) -> None:
    """Ledgers only grow: new rows are new files."""
    rows.write.mode("append").parquet(path)


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """A small state (a model, a switch) as a text file, replaced as a whole."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get_text(spark: SparkSession, path: str) -> str | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()).strip() or None


class KillSwitch:
    """Trading stops while this small JSON state says so, for 24 hours at most."""

    def __init__(self, hours: int = 24):
        self.hours = hours

    def on(self, reason: str, now: datetime | None = None) -> str:
        return json.dumps({"reason": reason, "at": (now or datetime.now(UTC)).isoformat()})

    def active(self, state: str | None, now: datetime | None = None) -> bool:
        return bool(state) and (now or datetime.now(UTC)) - datetime.fromisoformat(json.loads(state)["at"]) < timedelta(hours=self.hours)
