"""The latency ring on a stream against the batch report over the same rows."""

import datetime as dt

import numpy as np
import pytest

from tidewater.operators import monitor
from tidewater.streaming import latency

SCHEMA = "endpoint string, latency double, error boolean, ts timestamp, event_id long"


def requests(n, seed=0):
    r = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        name = ["hot", "hot", "hot", "cold", None][int(r.integers(0, 5))]
        out.append((name, float(r.gamma(2, 0.05)), bool(r.random() < 0.1), start + dt.timedelta(seconds=int(r.integers(0, n // 3))), k))  # times repeat
    return out


def report(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: str(r[0]))


@pytest.mark.parametrize("shares", [1, 5])
def test_ring_equals_the_batch_report(spark, tmp_path, shares):
    rows = requests(900)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    keep = 70
    for part in range(3):  # requests arrive out of order, in batches
        spark.createDataFrame(rows[part::3], SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        latency.keep_latencies(stream, out, keep, shares).awaitTermination()  # the next run goes on from the checkpoint
        seen = [r for k in range(part + 1) for r in rows[k::3]]
        want = monitor.latency_report(spark.createDataFrame(seen, SCHEMA), keep)
        assert report(latency.latency_report(spark, out, keep)) == report(want)
    rings = spark.read.parquet(f"{out}/rings/*")
    assert max(len(r["at"]) for r in rings.collect()) == keep
    assert rings.select("batch").distinct().count() >= 4
    assert spark.conf.get(latency.PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_eviction_writes_changed_slots_only():
    """The state of a ring after batches, with a store that counts what is written."""
    import pandas as pd

    class Value:
        now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, v):
            self.now = v

    class Slots(dict):
        written = 0

        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, k, v):
            self.written += 1
            self[k[0]] = v

    ring = latency.LatencyRing(4)
    ring.counts, ring.ring = Value(), Slots()
    feed = lambda at: list(ring.handleInputRows(("a", 0), iter([pd.DataFrame({"at": at, "id": at, "latency": np.array(at, float), "error": 0})]), None))
    feed([5, 1, 3])
    assert ring.ring.written == 3
    feed([2, 9])
    assert ring.ring.written == 5 and sorted(v[0] for v in ring.ring.values()) == [2, 3, 5, 9] and set(ring.ring) == {0, 1, 2, 3}
    feed([0])  # too old: nothing is written
    assert ring.ring.written == 5 and ring.counts.now == (6, 0)
