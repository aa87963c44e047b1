"""Texts kept as ordered pieces: a key for each long row, and digests that stream over a row's pieces.

A piece table has ``row`` (a number of the row, unique in its table), ``seq`` (place of the piece) and
columns of bytes. SHA-256 can't be composed from parts, so the pieces of one row meet in one task in
order; a task holds one Arrow batch of pieces at a time, whatever the size of the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): write what is made from it before it is used twice, as ``row`` is a number of this scan."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def streamed_sha256(pieces: DataFrame, *names: str) -> DataFrame:
    """(row, name_sha256...): digests of each row's byte columns, pieces in the order of ``seq``."""
    out = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(f"{n}_sha256", T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, done = None, [], []

        def rows(got):
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), *(pa.array([s[k] for _, s in got], pa.string()) for k in range(len(names)))], names=out.names)

        for batch in batches:
            columns = [column(batch, n).to_pylist() for n in names]
            for k, row in enumerate(column(batch, "row").to_pylist()):
                if row != now:
                    if now is not None:
                        done.append((now, [s.hexdigest() for s in sums]))
                    now, sums = row, [hashlib.sha256() for _ in names]
                for s, c in zip(sums, columns):
                    s.update(c[k] or b"")
            if done:
                yield rows(done)
                done = []
        if now is not None:
            yield rows([(now, [s.hexdigest() for s in sums])])

    return pieces.select("row", "seq", *names).repartition("row").sortWithinPartitions("row", "seq").mapInArrow(run, out)
