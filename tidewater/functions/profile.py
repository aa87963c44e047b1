"""Profiles of columns: counts by value, stored by value range, that later checks read instead of the rows.

A profile is two tables. ``ranges`` has the number of values in each of about 1,000 ranges of a column, and is small; ``values`` has
the count of each distinct value, laid out by range, so that a reader of a few ranges skips the rest. Quantiles and
shares below an edge are exact: the ranges say which ones hold an asked rank or edge, and only those are read by value. Profiles merge by adding counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from .ranks import _cuts, _splits
from .stats import one_row

VALUES, RANGES = "column string, range int, v double, n long", "column string, range int, n long"


class Profile:
    """A stored profile: its cuts, and its two tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.splits: dict[str, list[float]] = {c: [-math.inf, *inner, math.inf] for c, inner in json.loads(files.read_text(spark, f"{path}/cuts.json")).items()}

    @classmethod
    def build(cls, df: DataFrame, columns: Sequence[str], path: str) -> Profile:
        """Count ``df``'s values by range and value and store them; nulls and NaN are left out."""
        rows = df.select(*[_number(c) for c in columns])
        cuts = one_row(rows, [_cuts(c).alias(c) for c in columns])
        splits = {c: _splits(cuts[c]) for c in columns}
        return cls._store(df.sparkSession, _counts(rows, splits), splits, path)

    @classmethod
    def _store(cls, spark: SparkSession, counts: DataFrame, splits: Mapping[str, Sequence[float]], path: str) -> Profile:
        counts.repartitionByRange("column", "range").sortWithinPartitions("column", "range", "v").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/values")
        values = spark.read.schema(VALUES).parquet(f"{path}/values")
        values.groupBy("column", "range").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/ranges")
        files.write_text(spark, f"{path}/cuts.json", json.dumps({c: [float(x) for x in s[1:-1]] for c, s in splits.items()}))
        return cls(spark, path)

    @property
    def values(self) -> DataFrame:
        return self.spark.read.schema(VALUES).parquet(f"{self.path}/values")

    def sizes(self) -> dict[tuple[str, int], int]:
        """Number of values by column and range: some 1,000 for each column."""
        return {(r["column"], r["range"]): r["n"] for r in self.spark.read.schema(RANGES).parquet(f"{self.path}/ranges").collect()}

    def merged(self, other: Profile, path: str) -> Profile:
        """Both together, by this one's ranges; columns that only one has are left out."""
        splits = {c: s for c, s in self.splits.items() if c in other.splits}
        both = self.values.select("column", "v", "n").unionByName(other.values.select("column", "v", "n")).where(F.col("column").isin(*splits))
        return self._store(self.spark, _summed(both, splits), splits, path)


def _number(c: str):
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value).alias(c)


def _cut(rows: DataFrame, splits: Mapping[str, Sequence[float]]) -> DataFrame:
    """(column, range, v) of each value of wide ``rows``."""
    names = list(splits)
    cut = Bucketizer(inputCols=names, outputCols=[f"_range_{k}" for k in range(len(names))], splitsArray=[list(splits[c]) for c in names], handleInvalid="keep").transform(rows)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_range_{k}").cast("int").alias("range"), F.col(c).alias("v")) for k, c in enumerate(names)]
    return cut.select(F.inline(F.array(*parts))).where("v IS NOT NULL")


def _counts(rows: DataFrame, splits: Mapping[str, Sequence[float]]) -> DataFrame:
    return _cut(rows, splits).groupBy("column", "range", "v").agg(F.count(F.lit(1)).alias("n"))


def _summed(values: DataFrame, splits: Mapping[str, Sequence[float]]) -> DataFrame:
    """Counts by value with the ranges of ``splits``."""
    summed = values.groupBy("column", "v").agg(F.sum("n").alias("n"))
    frames = []
    for c, s in splits.items():
        cut = Bucketizer(inputCol="v", outputCol="_range", splits=list(s), handleInvalid="keep").transform(summed.where(F.col("column") == c))
        frames.append(cut.select("column", F.col("_range").cast("int").alias("range"), "v", "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Comparison:
    """A stored reference profile beside current rows cut by the same ranges."""

    def __init__(self, reference: Profile, current: DataFrame, columns: Sequence[str]):
        self.reference = reference
        self.splits = {c: reference.splits[c] for c in columns}
        self.rows = current.select(*[_number(c) for c in columns])
        counted = _cut(self.rows, self.splits).groupBy("column", "range").agg(F.count(F.lit(1)).alias("n")).collect()  # ranges only
        now = {(r["column"], r["range"]): r["n"] for r in counted}
        then = {k: n for k, n in reference.sizes().items() if k[0] in self.splits}
        self.sizes = {c: ({r: n for (x, r), n in then.items() if x == c}, {r: n for (x, r), n in now.items() if x == c}) for c in columns}

    def total(self, column: str, side: int) -> int:
        return sum(self.sizes[column][side].values())

    def _near(self, wanted: Sequence[tuple[str, int]]) -> DataFrame:
        """(column, range, v, then, now): counts by value in the wanted ranges, which are all that is read of the profile."""
        pick = F.lit(False)
        for c in {c for c, _ in wanted}:
            pick = pick | ((F.col("column") == c) & F.col("range").isin(*sorted({r for x, r in wanted if x == c})))
        then = self.reference.values.where(pick).select("column", "range", "v", F.col("n").alias("then"), F.lit(0).cast("long").alias("now"))
        now = _cut(self.rows, self.splits).where(pick).groupBy("column", "range", "v").agg(F.count(F.lit(1)).alias("now"))
        both = then.unionByName(now.select("column", "range", "v", F.lit(0).cast("long").alias("then"), "now"))
        return both.groupBy("column", "range", "v").agg(F.sum("then").alias("then"), F.sum("now").alias("now"))

    def pooled_percentiles(self, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
        """What ``percentile`` gives over reference and current rows together."""
        asked, bases = [], {}
        for c in columns:
            then, now = self.sizes[c]
            n = self.total(c, 0) + self.total(c, 1)
            ranks = sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)})
            base = 0
            for r in sorted({*then, *now}):
                size = then.get(r, 0) + now.get(r, 0)
                asked += [(c, r, rank, rank - base) for rank in ranks if base <= rank < base + size]
                bases[c, r] = base
                base += size
        frame = self.reference.spark.createDataFrame(asked, "column string, range int, rank long, at long")  # two ranks for each share
        inside = Window.partitionBy("column", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        near = self._near([(c, r) for c, r, *_ in asked]).withColumn("n", F.col("then") + F.col("now"))
        near = near.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        hits = near.join(F.broadcast(frame), ["column", "range"]).where("below <= at AND at < below + n").select("column", "rank", "v").collect()
        value = {(r["column"], r["rank"]): r["v"] for r in hits}

        def at(c: str, q: float) -> float:
            place = q * (self.total(c, 0) + self.total(c, 1) - 1)
            low, high = math.floor(place), math.ceil(place)
            a, b = value[c, low], value[c, high]
            return a if a == b or low == high else (high - place) * a + (place - low) * b

        return {c: [at(c, q) for q in shares] for c in columns}

    def shares_below(self, edges: Mapping[str, Sequence[float]]) -> dict[str, list[tuple[float, float]]]:
        """For each edge the share of reference and of current values at or below it."""
        where = {(c, e): sum(x <= e for x in self.splits[c][1:-1]) for c, es in edges.items() for e in es}
        frame = self.reference.spark.createDataFrame([(c, r, float(e)) for (c, e), r in where.items()], "column string, range int, edge double")
        near = self._near([(c, r) for (c, _), r in where.items()])
        got = near.join(F.broadcast(frame), ["column", "range"]).where("v <= edge").groupBy("column", "edge").agg(F.sum("then").alias("then"), F.sum("now").alias("now")).collect()
        inside = {(r["column"], r["edge"]): (r["then"], r["now"]) for r in got}
        out = {}
        for c, es in edges.items():
            out[c] = [tuple((sum(n for r, n in self.sizes[c][side].items() if r < where[c, e]) + inside.get((c, e), (0, 0))[side]) / self.total(c, side) for side in (0, 1)) for e in es]
        return out
