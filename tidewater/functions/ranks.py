"""Running sums and exact quantiles of whole tables, without sorting a table in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settle import settle
from .stats import one_row

#: Value ranges that a table is cut into; also the bound of what is broadcast or collected, for each column.
BUCKETS = 1000


def _splits(cuts: Sequence[float] | None) -> list[float]:
    inner = sorted({c for c in cuts or () if math.isfinite(c)}) or [0.0]
    return [-math.inf, *inner, math.inf]


def _cuts(column: str):
    return F.percentile_approx(column, F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)]), 10 * BUCKETS)


def prefix_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``df`` with, for each column c of ``sums``, c_before (its sum over the rows before in ``order``) and c_all.

    Value ranges of about equal numbers of rows are summed on their own and then take the totals of the ranges before them.
    The first column of ``order`` is a number; rows equal in it share a range, so count equal values first. Nulls come first."""
    df = settle(df)
    splits = _splits(one_row(df, [_cuts(order[0]).alias("c")])["c"])
    rows = df.withColumn("_value", F.col(order[0]).cast("double"))
    rows = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep").transform(rows)
    rows = rows.withColumn("_range", F.when(F.col("_value").isNull(), -1.0).otherwise(F.col("_range")))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    per = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    per = per.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in sums], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums]
    return rows.join(F.broadcast(per), "_range").select(*df.columns, *before, *[f"{c}_all" for c in sums])


def exact_percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """What ``percentile`` gives (linear interpolation; nulls left out), None for a column without values.

    Rows are counted by value range; only the ranges that hold an asked rank are then counted by value."""
    names = [f"c{j}" for j in range(len(columns))]
    values = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    cuts = one_row(values, [_cuts(n).alias(n) for n in names])
    cut = Bucketizer(inputCols=names, outputCols=[f"b{j}" for j in range(len(names))], splitsArray=[_splits(cuts[n]) for n in names], handleInvalid="keep").transform(values)
    parts = [F.struct(F.lit(j).alias("j"), F.col(f"b{j}").alias("b"), F.col(n).alias("v")) for j, n in enumerate(names)]
    rows = cut.select(F.inline(F.array(*parts))).where("v IS NOT NULL")
    sizes = sorted((r["j"], r["b"], r["n"]) for r in rows.groupBy("j", "b").agg(F.count(F.lit(1)).alias("n")).collect())  # ranges only

    total = [sum(n for k, _, n in sizes if k == j) for j in range(len(names))]
    wanted = []
    for j, n in enumerate(total):
        ranks = sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)}) if n else []
        base = 0
        for _, b, size in (s for s in sizes if s[0] == j):
            wanted += [(j, b, r, r - base) for r in ranks if base <= r < base + size]
            base += size
    if not wanted:
        return dict.fromkeys(columns)
    asked = df.sparkSession.createDataFrame(wanted, "j int, b double, rank long, at long")  # two ranks for each share
    near = rows.join(F.broadcast(asked.select("j", "b").distinct()), ["j", "b"], "left_semi").groupBy("j", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("j", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    hits = near.join(F.broadcast(asked), ["j", "b"]).where("below <= at AND at < below + n").select("j", "rank", "v").collect()
    value = {(r["j"], r["rank"]): r["v"] for r in hits}

    def at(j: int, q: float) -> float:
        place = q * (total[j] - 1)
        low, high = math.floor(place), math.ceil(place)
        a, b = value[j, low], value[j, high]
        return a if a == b or low == high else (high - place) * a + (place - low) * b

    return {c: [at(j, q) for q in shares] if total[j] else None for j, c in enumerate(columns)}
