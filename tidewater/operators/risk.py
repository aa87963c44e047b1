"""Risk: anomalies in daily series, calibration of scores, drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles, prefix_sums
from ..functions.stats import one_row
from ..sources.settle import settle

WINDOW = 15


def decompose(series: DataFrame) -> DataFrame:
    """(t, y) -> t, y, trend (centred median, edges replicated), weekly (median by t mod 7), residual.

    One series has one row for each day, so ordering it in one partition is small; give a ``key`` column for many series."""
    keys = ["key"] if "key" in series.columns else []
    half = WINDOW // 2
    ends = series.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.min_by("y", "t").alias("_ya"), F.max_by("y", "t").alias("_yb"))
    pad = F.explode(F.sequence(F.lit(1), F.lit(half))).alias("k")
    left = ends.select(*keys, "_a", "_ya", pad).select(*keys, (F.col("_a") - F.col("k")).cast("long").alias("t"), F.col("_ya").alias("y"), F.lit(True).alias("_pad"))
    right = ends.select(*keys, "_b", "_yb", pad).select(*keys, (F.col("_b") + F.col("k")).cast("long").alias("t"), F.col("_yb").alias("y"), F.lit(True).alias("_pad"))
    rows = series.select(*keys, F.col("t").cast("long").alias("t"), "y", F.lit(False).alias("_pad")).unionByName(left).unionByName(right)
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-half, half)
    rows = rows.withColumn("trend", F.percentile("y", F.lit(0.5)).over(w)).where(~F.col("_pad")).drop("_pad")
    rows = rows.withColumn("weekly", F.median(F.col("y") - F.col("trend")).over(Window.partitionBy(*keys, F.col("t") % 7)))
    return rows.withColumn("residual", F.col("y") - F.col("trend") - F.col("weekly"))


def mad_scores(series: DataFrame, threshold: float = 5.0) -> DataFrame:
    """t, score, flagged: |residual| over 1.4826 MAD."""
    d = decompose(series)
    keys = ["key"] if "key" in series.columns else []
    w = Window.partitionBy(*keys)
    d = d.withColumn("_m", F.median("residual").over(w))
    d = d.withColumn("_mad", F.median(F.abs(F.col("residual") - F.col("_m"))).over(w) * 1.4826)
    score = F.abs("residual") / F.nullif(F.col("_mad"), F.lit(0.0))
    return d.select(*keys, "t", "y", score.alias("score"), (score > threshold).alias("flagged"))


def mad_residual_detector(series: DataFrame, threshold: float = 5.0) -> DataFrame:
    out = mad_scores(series, threshold)
    if not out.where("score IS NULL").isEmpty():
        raise ValueError("the residuals do not vary")
    return out


# -- isolation forest -------------------------------------------------------------------------------------------------


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points: 1 for two points, none for one."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


#: Rows offered to a tree for each one that it takes.
OFFER = 2


def tree_samples(rows: DataFrame, n: int, n_trees: int, sample: int, seed: int = 0) -> DataFrame:
    """(tree, order, columns of ``rows`` but _row): rows offered to each tree, twice the sample on average or all there are.

    A row is offered to about n_trees * share trees, chosen by hashes of its number ``_row``: a first tree and a
    stride without a common divisor with the number of trees. So one hash decides for most rows of a large table, and equal
    rows are offered apart. A tree takes the ``sample`` rows that come first in its own hash ``order``."""
    share = min(1.0, OFFER * sample / n)
    whole, part = divmod(n_trees * share, 1)
    strides = [k for k in range(1, max(2, n_trees)) if math.gcd(k, n_trees) == 1]
    draw = lambda salt, below: F.pmod(F.xxhash64("_row", F.lit(seed), F.lit(salt)), F.lit(below))
    times = F.lit(int(whole)) + (draw(1, 1 << 30) < int(part * (1 << 30))).cast("int")
    stride = F.element_at(F.array(*map(F.lit, strides)), (draw(3, len(strides)) + 1).cast("int"))
    trees = F.transform(F.sequence(F.lit(0), times - 1), lambda j: F.pmod(draw(2, n_trees) + j * stride, F.lit(n_trees)).cast("int"))
    offered = rows.where(times > 0).select("*", F.explode(trees).alias("tree"))
    return offered.withColumn("order", F.xxhash64("_row", "tree", F.lit(seed))).drop("_row")


def _grow(x: np.ndarray, limit: int, rng) -> np.ndarray:
    """Nodes as rows (feature or -1, cut or leaf depth, child below, child not below)."""
    nodes: list[list[float]] = []
    work = [(x, 0, -1, 0)]
    while work:
        part, depth, parent, side = work.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if depth < limit and len(part) > 1 else ()
        if not len(spread):
            nodes.append([-1, depth + float(average_path(len(part))), len(nodes), len(nodes)])
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        below = part[:, f] < cut
        nodes.append([f, cut, 0, 0])
        work += [(part[~below], depth + 1, len(nodes) - 1, 3), (part[below], depth + 1, len(nodes) - 1, 2)]
    return np.array(nodes)


def grow_forest(rows: DataFrame, features: list[str], n: int, n_trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """(tree, node, feature, cut, below, above): each tree grows in a task of its own from its share of all rows.

    ``rows`` has the features and ``_row``, a number of the row. A leaf has feature -1 and its depth, with the mean depth of what is left in it, as cut."""
    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["order", *features])[features].to_numpy(float)[:size]
        f, cut, below, above = _grow(x, limit, np.random.default_rng([seed, tree])).T
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f)), "feature": f.astype(int), "cut": cut, "below": below.astype(int), "above": above.astype(int)})

    offered = tree_samples(rows.select("_row", *features), n, n_trees, size, seed)
    return offered.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, below int, above int")


def _mean_depth(trees: list[tuple[np.ndarray, ...]], x: np.ndarray, limit: int) -> np.ndarray:
    total = np.zeros(len(x))
    each = np.arange(len(x))
    for f, cut, below, above in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(limit):
            at = np.where(x[each, f[at]] < cut[at], below[at], above[at])  # a leaf leads to itself
        total += cut[at]
    return total / len(trees)


def isolation_scores(spark: SparkSession, df: DataFrame, features: list[str], n_trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """``df`` with a score in (0, 1]: trees grow in tasks from samples of all rows, scoring is one pass in Arrow batches.

    What the driver holds is the forest, n_trees * 2 * sample nodes at most whatever the rows."""
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return df.withColumn("score", F.lit(None).cast("double"))
    size = min(sample, n)
    forest = grow_forest(rows, features, n, n_trees, sample, seed).toPandas().sort_values(["tree", "node"])
    trees = [tuple(g[c].to_numpy() for c in ("feature", "cut", "below", "above")) for _, g in forest.groupby("tree")]
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    norm = max(float(average_path(size)), 1e-9)

    def score(batches):
        for pdf in batches:
            yield pdf.assign(score=2.0 ** (-_mean_depth(trees, pdf[features].to_numpy(float), limit) / norm))

    from pyspark.sql import types as T

    return rows.drop("_row").mapInPandas(score, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def isolation_forest_detector(spark: SparkSession, series: DataFrame, n_flags: int, **options) -> DataFrame:
    """The n most isolated days by (residual, first difference), in order of t."""
    w = Window.partitionBy(*(["key"] if "key" in series.columns else [])).orderBy("t")
    d = decompose(series).withColumn("diff", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0)))
    scored = isolation_scores(spark, d.select("t", "residual", "diff"), ["residual", "diff"], **options)
    return scored.orderBy(F.desc("score"), "t").limit(n_flags).orderBy("t")


# -- scores -----------------------------------------------------------------------------------------------------------


def auc(df: DataFrame, label: str = "label", score: str = "p") -> float:
    """Mann-Whitney with tie averaging, over counts of distinct scores."""
    counts = df.groupBy(F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    r = one_row(prefix_sums(counts, ["v"], ["n"]), [F.sum(rank * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n")])
    p, n = r["p"] or 0, r["n"] or 0
    if not p or p == n:
        raise ValueError("both classes are needed")
    return (r["r"] - p * (p + 1) / 2) / (p * (n - p))


def brier_score(df: DataFrame, label: str = "label", score: str = "p") -> float:
    return one_row(df, [F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("b")])["b"]


def reliability_curve(df: DataFrame, label: str = "label", score: str = "p", bins: int = 10, close_last: bool = False) -> DataFrame:
    """bin, mean_pred, observed, n over [0, 1] in equal bins; a score of 1 is in no bin unless the last is closed."""
    k = F.floor(F.col(score) * bins).cast("int")
    if close_last:
        k = F.least(k, F.lit(bins - 1))
    rows = df.withColumn("bin", k).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy("bin").agg(F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(curve: DataFrame) -> float:
    return one_row(curve, [(F.sum(F.abs(F.col("mean_pred") - F.col("observed")) * F.col("n")) / F.sum("n")).alias("e")])["e"] or 0.0


def threshold_costs(df: DataFrame, cost_fp: float, cost_fn: float, label: str = "label", score: str = "p") -> DataFrame:
    """threshold, cost: candidates 0, 1 and the scores rounded to 4 digits; a score at or over the threshold is flagged.

    Rows are first counted by distinct score, so the running sums go over scores, not rows."""
    if cost_fp <= 0 or cost_fn <= 0:
        raise ValueError("costs are positive")
    by_score = df.groupBy(F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cand = by_score.select(F.bround("v", 4).alias("v")).union(df.sparkSession.createDataFrame([(0.0,), (1.0,)], "v double")).distinct()
    rows = by_score.select("v", "pos", "neg", F.lit(1).alias("row")).unionByName(cand.select("v", F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(0).alias("row")))
    # a candidate stands before the rows of its own value: those are flagged
    rows = prefix_sums(rows, ["v", "row"], ["pos", "neg"])
    return rows.where("row = 0").select(F.col("v").alias("threshold"), (F.lit(cost_fp) * (F.col("neg_all") - F.col("neg_before")) + F.lit(cost_fn) * F.col("pos_before")).alias("cost"))


def cost_optimal_threshold(df: DataFrame, cost_fp: float, cost_fn: float, **columns) -> tuple[float, float]:
    r = threshold_costs(df, cost_fp, cost_fn, **columns).orderBy("cost", "threshold").first()
    return r["threshold"], r["cost"]


# -- drift ------------------------------------------------------------------------------------------------------------


def psi_bins(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, expected, actual: shares in the reference's quantile bins, floored at 1e-6."""
    edges = sorted(set(exact_percentiles(reference, [column], [k / bins for k in range(1, bins)])[column]))

    def shares(df: DataFrame, name: str) -> DataFrame:
        k = F.lit(0)
        for e in edges:
            k = k + (F.col(column) >= F.lit(e)).cast("int")
        n = df.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    all_bins = reference.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(shares(reference, "expected"), "bin", "left").join(shares(current, "actual"), "bin", "left")
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-6)).alias(c)
    return out.select("bin", floor("expected"), floor("actual"))


def population_stability_index(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> tuple[float, str]:
    if min(reference.count(), current.count()) < 5 * bins:
        raise ValueError("too few observations for the bins")
    e, a = F.col("expected"), F.col("actual")
    psi = one_row(psi_bins(reference, current, column, bins), [F.sum((a - e) * F.log(a / e)).alias("p")])["p"]
    return psi, "stable" if psi < 0.1 else "watch" if psi < 0.25 else "alarm"


def pandas_series(values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"t": np.arange(len(values)), "y": values})

