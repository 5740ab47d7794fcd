"""Streams: Page-Hinkley decay per formula and kill switches as state with timers, and upserted panels and ledgers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "m double, alarms int, triggered_at timestamp, n int"
OUT = "formula_id string, m double, alarms int, triggered boolean, triggered_at timestamp, n_observations int"


def on_disk(df: DataFrame) -> DataFrame:
    """``df``; streams that its session starts from now on keep their state in RocksDB, on disk and in the checkpoint folder, not in the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


class DecayState(StatefulProcessor):
    """Four numbers for each formula; rows of a batch are folded in date order, a triggered state stays."""

    def __init__(self, threshold: float, floor: float, extreme: float, patience: int):
        self.threshold, self.floor, self.extreme, self.patience = threshold, floor, extreme, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decay", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        at = None if pd.isna(r["triggered_at"]) else pd.Timestamp(r["triggered_at"]).to_pydatetime()
        self.state.update((float(r["m"]), int(r["alarms"]), at, int(r["n"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m, alarms, at, n = self.state.get() if self.state.exists() else (0.0, 0, None, 0)
        for r in pd.concat(list(rows)).sort_values("date", kind="stable").itertuples():
            if at is not None:
                break
            n += 1
            if pd.isna(r.ret):
                continue
            sigma, short = max(r.sigma, 1e-12), r.mu - r.ret
            m = max(0.0, m + short - 0.5 * sigma)
            if short <= self.extreme * sigma:
                alarms = alarms + 1 if m > self.threshold and short > self.floor * sigma else 0
            if alarms >= self.patience:
                at = r.date.to_pydatetime()
        self.state.update((m, alarms, at, n))
        yield pd.DataFrame({"formula_id": [key[0]], "m": [m], "alarms": pd.array([alarms], "int32"), "triggered": [at is not None], "triggered_at": pd.to_datetime([at]), "n_observations": pd.array([n], "int32")})

    def close(self) -> None:
        pass


def decay_stream(returns: DataFrame, threshold: float = 0.01, floor: float = 2.0, extreme: float = 3.5, patience: int = 5, initial: DataFrame | None = None) -> DataFrame:
    """``returns(formula_id, date timestamp, ret, mu, sigma)`` as a stream -> the state after each batch, update mode.

    ``initial(formula_id, m, alarms, triggered_at, n)``: a batch of states to begin with, as an earlier batch run left them.
    """
    start = None if initial is None else initial.select("formula_id", *[c.split()[0] for c in STATE.split(", ")]).groupBy("formula_id")
    return on_disk(returns).groupBy("formula_id").transformWithStateInPandas(DecayState(threshold, floor, extreme, patience), OUT, "Update", "None", initialState=start)


class Switch(StatefulProcessor):
    """Until when an account is stopped, with a timer for that moment of event time."""

    def __init__(self, hours: float):
        self.length = timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("until", "until timestamp, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, reason = self.state.get() if self.state.exists() else (None, None)
        out, since = [], until
        for r in pd.concat(list(rows)).sort_values(["at", "reason"], kind="stable").itertuples():
            at = r.at.to_pydatetime()
            if until is not None and at >= until:
                out.append((until, "off", reason))
                until = None
            out.append((at, "on" if until is None else "again", r.reason))
            until, reason = at + self.length, r.reason
        if since is not None:
            self.handle.deleteTimer(_millis(since))
        self.state.update((until, reason))
        self.handle.registerTimer(_millis(until))
        yield _switched(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, reason = self.state.get()
        self.state.clear()
        yield _switched(key[0], [(until, "off", reason)])

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return int(pd.Timestamp(at, tz="UTC").timestamp() * 1000)


def _switched(account: str, rows: list[tuple]) -> pd.DataFrame:
    at, turned, reason = zip(*rows)
    return pd.DataFrame({"account": [account] * len(rows), "at": pd.to_datetime(list(at)), "turned": turned, "reason": reason})


def kill_switch(alarms: DataFrame, hours: float = 24, delay: str = "0 seconds") -> DataFrame:
    """``alarms(account, at timestamp, reason)`` as a stream -> when each account was stopped (on), stopped anew (again) and let go (off); append mode.

    A stop ends ``hours`` after the last alarm: by a timer once the watermark has passed that moment, or when a later
    alarm shows that it has. The session's time zone must be UTC. Accounts that are not stopped have no state.
    """
    keyed = on_disk(alarms).withWatermark("at", delay).groupBy("account")
    return keyed.transformWithStateInPandas(Switch(hours), "account string, at timestamp, turned string, reason string", "Append", "EventTime")


def windowed_pnl(trades: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Weighted result per tumbling window of a trade stream; rows later than ``delay`` are dropped by the watermark."""
    return trades.withWatermark("date", delay).groupBy(F.window("date", width)).agg(F.sum(F.col("net_pnl_pct") * F.col("weight")).alias("pnl"), F.count("*").alias("n"))


def upsert_sink(path: str, keys: list[str]):
    """A foreachBatch function that keeps one row per key: the batch's rows win over those stored.

    Each batch is written beside the stored table and the reader takes the newest version, so a repeated batch
    changes nothing. Of a batch's rows with one key the greatest by its other columns, in their order, is kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*keys, "__row.*")
        one.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserted(spark, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("__batch")).alias("r")).select(*keys, "r.*")
