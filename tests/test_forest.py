"""Isolation forest: samples from all rows, trees grown in tasks, scores against a plain recursion."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators import risk


def rows_of(spark, n, seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"a": r.normal(0, 1, n), "b": r.normal(0, 1, n)})).withColumn("_row", F.monotonically_increasing_id())


def test_samples_come_from_all_rows_and_stay_bounded(spark):
    """A table of equal rows: every tree gets about twice its sample, from anywhere in the table."""
    n, trees, sample = 60_000, 40, 64
    df = spark.range(n).select(F.lit(1.0).alias("a"), F.col("id").alias("place"), F.col("id").alias("_row"))
    got = risk.tree_samples(df, n, trees, sample).groupBy("tree").agg(F.count("*").alias("n"), F.avg("place").alias("m"), F.min("place").alias("lo"), F.max("place").alias("hi")).toPandas()
    assert len(got) == trees and got["n"].between(75, 185).all()
    assert got["m"].between(n * 0.35, n * 0.65).all() and (got["lo"] < n * 0.15).all() and (got["hi"] > n * 0.85).all()


def test_small_tables_offer_every_row_once_to_each_tree(spark):
    df = spark.range(90).select(F.col("id").alias("_row"), F.col("id").cast("double").alias("a"))
    got = risk.tree_samples(df, 90, 30, 64).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).collect()
    assert len(got) == 30 and {(r["n"], r["d"]) for r in got} == {(90, 90)}


def test_scores_equal_a_recursion_over_the_same_trees(spark):
    df = rows_of(spark, 500).cache()
    n, sample, trees = 500, 32, 25
    forest = risk.grow_forest(df, ["a", "b"], n, trees, sample).toPandas()
    assert forest["tree"].nunique() == trees and forest.groupby("tree").size().max() <= 2 * sample

    def depth(tree, x, node=0, at=0):
        r = tree.iloc[node]
        if r["feature"] < 0:
            return r["cut"]
        return depth(tree, x, int(r["below"] if x[int(r["feature"])] < r["cut"] else r["above"]), at + 1)

    x = df.toPandas()[["a", "b"]].to_numpy()
    parts = [g.sort_values("node") for _, g in forest.groupby("tree")]
    limit = math.ceil(math.log2(sample))
    fast = risk._mean_depth([tuple(g[c].to_numpy() for c in ("feature", "cut", "below", "above")) for g in parts], x[:40], limit)
    slow = [np.mean([depth(g, v) for g in parts]) for v in x[:40]]
    assert np.allclose(fast, slow)


def test_outliers_score_highest_whatever_the_partitions(spark):
    df = rows_of(spark, 3000).drop("_row").unionByName(spark.createDataFrame([(9.0, -9.0), (-8.0, 8.0)], "a double, b double"))
    got = risk.isolation_scores(spark, df, ["a", "b"]).orderBy(F.desc("score")).limit(2).collect()
    assert {round(r["a"]) for r in got} == {9, -8}
    assert risk.isolation_scores(spark, df.limit(0), ["a", "b"]).count() == 0
    one = risk.isolation_scores(spark, df.limit(1), ["a", "b"]).collect()
    assert len(one) == 1
    assert float(risk.average_path(2)) == 1.0 and float(risk.average_path(1)) == 0.0
