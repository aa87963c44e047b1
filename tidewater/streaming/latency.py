"""The latency buffer on a stream: the last requests of each endpoint as state, with eviction.

A stateful operator keeps a ring of slots for each (endpoint, share): a new request takes a free slot or that of the oldest kept one, if it
is later. Late requests find their place by time, so the ring holds the same rows however they arrive. State sits in RocksDB
as one entry for each slot, of which only changed ones are written. An endpoint's requests are dealt over shares by hash, so a hot
endpoint is many keys; its last requests are among the last of each share, and the report merges the shares.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.monitor import latency_figures, latest

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "endpoint string, share int, n long, errors long, at array<long>, id array<long>, latency array<double>"


class LatencyRing(StatefulProcessor):
    """Counts, and the slots of the last ``keep`` requests by (at, id)."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", "n long, errors long")
        self.ring = handle.getMapState("ring", "slot int", "at long, id long, latency double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, errors = self.counts.get() if self.counts.exists() else (0, 0)
        kept = [(slot, *value) for (slot,), value in self.ring.iterator()]
        slot, at, ids, latency = (np.array([k[j] for k in kept], t) for j, t in enumerate((np.int64, np.int64, np.int64, float)))
        before = dict(zip(slot.tolist(), zip(at.tolist(), ids.tolist(), latency.tolist())))
        for more in rows:
            n, errors = n + len(more), errors + int(more["error"].sum())
            slot = np.concatenate([slot, np.full(len(more), -1)])
            at, ids, latency = (np.concatenate([a, more[c].to_numpy()]) for a, c in ((at, "at"), (ids, "id"), (latency, "latency")))
            last = np.lexsort((latency, ids, at))[-self.keep :]
            slot, at, ids, latency = slot[last], at[last], ids[last], latency[last]
        free = np.setdiff1d(np.arange(len(slot)), slot)  # slots never used or whose request was evicted
        slot[slot < 0] = free[: (slot < 0).sum()]
        for s, *value in zip(slot.tolist(), at.tolist(), ids.tolist(), latency.tolist()):
            if before.get(s) != tuple(value):
                self.ring.updateValue((s,), tuple(value))
        self.counts.update((n, errors))
        yield pd.DataFrame({"endpoint": pd.Series([key[0]], dtype=object), "share": [key[1]], "n": [n], "errors": [errors], "at": [at], "id": [ids], "latency": [latency]})

    def close(self) -> None:
        pass


def latency_rings(requests: DataFrame, keep_last: int = 10_000, shares: int = 16) -> DataFrame:
    """A stream of (endpoint, share, n, errors, at, id, latency): the state of each share that a batch has changed.

    ``requests`` has (endpoint, latency, error, ts, event_id)."""
    rows = requests.select("endpoint", "latency", F.col("error").cast("int").alias("error"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("id"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("at", "id"), F.lit(shares)).cast("int"))
    return rows.groupBy("endpoint", "share").transformWithStateInPandas(LatencyRing(keep_last), KEPT, outputMode="Update", timeMode="None")


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Stateful operators of this kind need a store with more than one kind of state."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def keep_latencies(requests: DataFrame, path: str, keep_last: int = 10_000, shares: int = 16):
    """Start a query over all that is there: each batch's changed rings go to ``path``/rings, once by its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rings/{number:012d}")

    with rocks_state(requests.sparkSession):
        return latency_rings(requests, keep_last, shares).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def latency_report(spark: SparkSession, path: str, keep_last: int = 10_000) -> DataFrame:
    """endpoint, p50, p95, p99, n, error_rate as of the last batch under ``path``: what the batch report gives on the same rows."""
    rings = spark.read.schema(f"{KEPT}, batch long").parquet(f"{path}/rings/*")
    names = ("n", "errors", "at", "id", "latency")
    now = rings.groupBy("endpoint", "share").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("endpoint", *(F.col(f"r.{c}").alias(c) for c in names))
    by = now.groupBy("endpoint").agg(F.sum("n").alias("n"), (F.sum("errors") / F.sum("n")).alias("error_rate"))
    rows = now.select("endpoint", F.explode(F.arrays_zip("at", "id", "latency")).alias("r")).select("endpoint", "r.*")
    return latency_figures(latest(rows, keep_last, ("at", "id")), by)
