"""Monitoring: column drift, calibration, latency, throughput, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import Comparison, Profile
from ..functions.ranks import exact_percentiles
from ..functions.stats import one_row
from ..sources.settle import shared_folder
from .churn import calibration_summary

MIN_VALUES = 10


def ks_drift(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """column, statistic, drifted: largest gap of the empirical distributions over pooled decile edges.

    The edges of all columns are found together, the gaps in one more pass; columns with under 10 values are left out."""
    both = reference.select(*columns, F.lit(0).alias("_side")).unionByName(current.select(*columns, F.lit(1).alias("_side")))
    first = one_row(both, [F.count(F.when(F.col("_side") == side, F.col(c))).alias(f"{k}_{c}") for c in columns for side, k in enumerate("rc")])
    used = [c for c in columns if min(first[f"r_{c}"], first[f"c_{c}"]) >= MIN_VALUES]
    if not used:
        return both.sparkSession.createDataFrame([], "column string, statistic double, drifted boolean")
    edges = exact_percentiles(both, used, [k / 10 for k in range(11)])

    def gap(c: str):
        below = lambda side, e: F.avg(F.when((F.col("_side") == side) & F.col(c).isNotNull(), (F.col(c) <= F.lit(e)).cast("double")))
        return F.greatest(*[F.abs(below(0, e) - below(1, e)) for e in edges[c]])

    stats = both.agg(*[F.struct(F.lit(c).alias("column"), gap(c).alias("statistic")).alias(c) for c in used])
    return stats.select(F.explode(F.array(*used)).alias("x")).select("x.*", (F.col("x.statistic") > threshold).alias("drifted"))


def ks_drift_profile(reference: Profile, current: DataFrame, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """The same against a stored profile of the reference, whose rows are not read again."""
    both = Comparison(reference, current, columns)
    used = [c for c in columns if min(both.total(c, 0), both.total(c, 1)) >= MIN_VALUES]
    gaps = {}
    if used:
        shares = both.shares_below(both.pooled_percentiles(used, [k / 10 for k in range(11)]))
        gaps = {c: max(abs(a - b) for a, b in shares[c]) for c in used}
    rows = [(c, float(g), bool(g > threshold)) for c, g in gaps.items()]
    return current.sparkSession.createDataFrame(rows, "column string, statistic double, drifted boolean")


NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


class DriftMonitor:
    """Holds the profile of a reference, stored once and read by every later check, also of another session; without one a check only warns."""

    def __init__(self, threshold: float = 0.1, profile: Profile | None = None):
        self.threshold, self.profile = threshold, profile

    def set_reference(self, df: DataFrame, path: str | None = None) -> Profile:
        """Profile the numeric columns of ``df`` under ``path`` (a new folder of the shared one by default)."""
        self.profile = Profile.build(df, [c for c, k in df.dtypes if k in NUMBERS], path or shared_folder(df.sparkSession, "profile"))
        return self.profile

    def check(self, current: DataFrame, predictions: str | None = None) -> dict:
        if self.profile is None:
            return {"drifted": [], "prediction_drift": False, "any_drift": False, "warning": "no reference set"}
        names = [c for c, k in current.dtypes if k in NUMBERS and c in self.profile.splits and c != predictions]
        found = ks_drift_profile(self.profile, current, names, self.threshold).where("drifted").collect() if names else []
        mean = one_row(current, [F.avg(predictions).alias("m")])["m"] if predictions else None
        moved = mean is not None and (mean > 0.7 or mean < 0.1)
        drifted = sorted(r["column"] for r in found)
        return {"drifted": drifted, "prediction_drift": moved, "any_drift": bool(drifted) or moved, "warning": None}


def calibration_check(scored: DataFrame, label: str = "label", bins: int = 10, limit: float = 0.05) -> dict:
    m = one_row(scored, [F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_if(~F.col(label).isin(0, 1)).alias("odd")])
    if m["n"] and (m["lo"] < 0 or m["hi"] > 1 or m["odd"]):
        raise ValueError("probabilities lie in [0, 1] and labels are 0 or 1")
    if m["n"] < 2 * bins:
        return {"ece": 0.0, "calibrated": False, "n": m["n"], "warning": "too few rows"}
    curve = calibration_summary(scored, label, bins)
    ece = one_row(curve, [(F.sum(F.abs(F.col("mean_pred") - F.col("observed")) * F.col("n")) / F.sum("n")).alias("e")])["e"]
    return {"ece": ece, "calibrated": ece <= limit, "n": m["n"], "warning": None}


def latest(rows: DataFrame, keep_last: int, order: tuple[str, ...]) -> DataFrame:
    """The last ``keep_last`` rows of each endpoint: an endpoint is dealt over shares by hash, and the last of it are among the last of each share."""
    by = [F.desc(c) for c in order]
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(256)))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("endpoint", "_share").orderBy(*by))).where(F.col("_rank") <= keep_last)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("endpoint").orderBy(*by))).where(F.col("_rank") <= keep_last).drop("_share", "_rank")


def latency_figures(last: DataFrame, by: DataFrame) -> DataFrame:
    """``by`` (endpoint, n, error_rate) with the nearest-rank percentiles of the kept rows (endpoint, latency), in ms with 2 digits."""
    last = last.groupBy("endpoint").agg(F.sort_array(F.collect_list("latency")).alias("_v"))  # at most keep_last values
    by = by.withColumnRenamed("endpoint", "_endpoint").join(last, F.col("_endpoint").eqNullSafe(F.col("endpoint")))
    at = lambda q: F.round(F.get("_v", F.least(F.floor(F.size("_v") * q), F.size("_v") - 1).cast("int")) * 1000, 2)
    return by.select("endpoint", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "n", "error_rate")


def latency_report(requests: DataFrame, keep_last: int = 10_000, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """endpoint, p50, p95, p99 (nearest rank over the last ``keep_last`` of each endpoint, ms, 2 digits), n, error_rate (over all).

    ``streaming.latency`` keeps the same figures on a stream."""
    by = requests.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("error").cast("double")).alias("error_rate"))
    return latency_figures(latest(requests.select("endpoint", "latency", *order), keep_last, order), by)


def throughput_report(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """total, window_s, rps."""
    r = requests.agg(F.count(F.lit(1)).alias("total"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) / 1e6 - F.unix_micros(F.min(F.col(ts).cast("timestamp"))) / 1e6).alias("window_s"))
    return r.withColumn("rps", F.col("total") / F.nullif(F.col("window_s"), F.lit(0.0)))


def data_freshness(transactions: DataFrame, reference_time: dt.datetime, max_age_hours: float = 48.0, column: str = "txn_date") -> dict:
    """Age of the newest row; a source that cannot be read is stale."""
    try:
        last = one_row(transactions, [F.max(column).alias("m")])["m"]
    except Exception as e:
        return {"last": None, "hours": float("inf"), "fresh": False, "error": str(e).splitlines()[0]}
    if last is None:
        return {"last": None, "hours": float("inf"), "fresh": False, "error": "no rows"}
    if not isinstance(last, dt.datetime):
        last = dt.datetime.combine(last, dt.time())
    hours = max(0.0, (reference_time.replace(tzinfo=None) - last.replace(tzinfo=None)).total_seconds() / 3600)
    return {"last": last, "hours": hours, "fresh": hours <= max_age_hours, "error": None}
