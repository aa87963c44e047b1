"""What several operators share: the shared folder, Arrow batches as byte arrays, rolling hashes.

Hashes are 64-bit polynomials over a fixed random byte table, modulo 2**64, so the hash of any
byte range comes from one prefix sum per batch. They are functions of content alone: the same
bytes hash alike in every task, size and run.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once (about 100 bytes of memory each).
SLICE_BYTES = 2_000_000
U64 = np.uint64
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def own_name(name: str) -> str:
    """A column name that no table of a user has."""
    return f"_{name}_{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While an eager job runs, hand Python at most so many rows at once: whole texts make batches large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete stashed tables that no later step reads, and let Spark drop the shuffles that only they had."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._stashed)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()  # plans that only this process still holds
    if frames:
        jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, text): id and fp name a row by content, so repeated ids and null ids stay apart.

    Ids are integers, or strings that hold one; under ANSI rules any other string raises."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["fp"] == b["fp"])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        m = max(n + 1, SLICE_BYTES + 4096)
        for k, p in enumerate((_P, _PINV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] the hash of buf[s:e] times P**s."""
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * powers(len(buf))[0][: len(buf)], out=c[1:])
    return c


def range_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((c[e] - c[s]) * powers(len(c))[1][s] + (e - s).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    else:
        off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one text if it is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows, chosen by the hash of ``key`` against a threshold from the row count: nothing is sorted or gathered."""
    share = min(1.0, n / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1)))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes other than 09-0D and 20."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last = ink
    last[:-1] &= ~ink[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(buf), s, e)


_GRAM = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(64)], np.uint64)


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n consecutive words of one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g += h[k : k + m] * _GRAM[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[at]), at


def shingles(buf: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-word shingles; a shorter text with words has one of all its words."""
    s, e, doc = word_bounds(buf, off)
    h = word_hashes(buf, s, e)
    g, at = gram_hashes(h, doc, n)
    d = doc[at]
    count = np.bincount(doc, minlength=len(off) - 1)
    small = np.flatnonzero((count > 0) & (count < n))
    if len(small):
        pick = np.isin(doc, small)
        begins = np.concatenate([[0], np.cumsum(count)])[:-1]
        k = np.arange(len(doc)) - begins[doc]
        part = h[pick] * _GRAM[k[pick] + 8]
        g = np.concatenate([g, mix(np.add.reduceat(part, np.flatnonzero(k[pick] == 0)))])
        d = np.concatenate([d, doc[pick][k[pick] == 0]])
    if not len(g):
        return d, g
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[keep], g[keep]
