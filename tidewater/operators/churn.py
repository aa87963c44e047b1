"""Leakage-safe churn: windowed features, temporal splits, champion selection with pyspark.ml, scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import prefix_sums
from ..functions.stats import one_row
from ..sources import files
from ..sources.settle import settle
from .risk import auc

#: The serving contract, in order.
CHANNELS = ("display", "organic", "search", "social", "video")
PLANS = ("basic", "pro")
NUMERIC = ("tenure_days", "txn_count_obs", "total_spend_obs", "avg_txn_amount_obs", "days_since_last_txn", "txn_freq_monthly", "had_fraud_obs", "signup_dow", "signup_month")
CUTOFF_DAYS, HORIZON_DAYS = 120, 30


def feature_names(channels=CHANNELS, plans=PLANS) -> tuple[str, ...]:
    return (*NUMERIC, *(f"channel_{c}" for c in channels), *(f"plan_{p}" for p in plans))


def churn_features(signups: DataFrame, transactions: DataFrame, ad_spend: DataFrame | None = None, cutoff: int = CUTOFF_DAYS, horizon: int = HORIZON_DAYS, channels=CHANNELS, plans=PLANS) -> DataFrame:
    """One row for each eligible subscriber: features of days [0, cutoff), label of days [cutoff, cutoff + horizon).

    Features and label come from one conditional aggregate over one join; the bounds are one broadcast row."""
    bounds = signups.agg(F.max("signup_date").alias("a")).join(transactions.agg(F.max("txn_date").alias("b")))
    if ad_spend is not None:
        bounds = bounds.join(ad_spend.agg(F.max("date").alias("c")))
    end = bounds.select(F.greatest(*bounds.columns).alias("_end"))
    users = signups.where(F.col("subscribed") & F.col("plan").isNotNull()).join(F.broadcast(end)).where(F.date_add("signup_date", cutoff + horizon) <= F.col("_end")).drop("_end")
    tx = transactions.select("user_id", "txn_date", "amount", "is_fraud")
    rows = users.join(tx.hint("merge"), "user_id", "left").withColumn("_d", F.datediff("txn_date", "signup_date"))
    seen = (F.col("_d") >= 0) & (F.col("_d") < cutoff)
    ahead = (F.col("_d") >= cutoff) & (F.col("_d") < cutoff + horizon)
    amount = F.when(seen, F.col("amount"))
    out = rows.groupBy("user_id", "signup_date", "channel", "plan").agg(
        F.count(F.when(seen, 1)).alias("txn_count_obs"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_spend_obs"),
        F.coalesce(F.avg(amount), F.lit(0.0)).alias("avg_txn_amount_obs"),
        F.coalesce(F.bool_or(seen & F.col("is_fraud")), F.lit(False)).cast("int").alias("had_fraud_obs"),
        F.max(F.when(seen, F.col("_d"))).alias("_last"),
        F.when(F.count(F.when(ahead, 1)) == 0, 1).otherwise(0).alias("churned"),
    )
    last = F.greatest(F.coalesce("_last", F.lit(0)), F.lit(0))
    return out.select(
        "user_id", "signup_date", F.lit(cutoff).alias("tenure_days"), "txn_count_obs", "total_spend_obs", "avg_txn_amount_obs", (F.lit(cutoff) - last).alias("days_since_last_txn"),
        (F.col("txn_count_obs") / F.lit(cutoff / 30)).alias("txn_freq_monthly"), "had_fraud_obs",
        F.weekday("signup_date").alias("signup_dow"), F.month("signup_date").alias("signup_month"), *[(F.col("channel") == c).cast("int").alias(f"channel_{c}") for c in channels], *[(F.col("plan") == p).cast("int").alias(f"plan_{p}") for p in plans], "churned",
    )


def numbered(training: DataFrame) -> DataFrame:
    """rn (from 1, by signup date and user) and n.

    Positions come from counts by date, so only the users of one date meet in a task."""
    days = training.groupBy("signup_date").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("signup_date", F.coalesce(F.sum("_n").over(Window.orderBy("signup_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    rows = training.join(days, "signup_date")
    return rows.withColumn("rn", F.col("_before") + F.row_number().over(Window.partitionBy("signup_date").orderBy("user_id"))).drop("_before")


def temporal_split(training: DataFrame, share: float = 0.8) -> DataFrame:
    """The rows with ``part``: dev (the first by date) or holdout."""
    return numbered(training).withColumn("part", F.when(F.col("rn") <= F.floor(F.col("n") * share), "dev").otherwise("holdout"))


def folds(dev: DataFrame, n_splits: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding windows: each of the last n blocks of n // (splits + 1) rows is tested on all rows before it."""
    rows = settle(numbered(dev.drop("rn", "n", "part")))
    n = rows.count()
    size = n // (n_splits + 1)
    edges = [n - (n_splits - k) * size for k in range(n_splits)]
    return [(rows.where(F.col("rn") <= e), rows.where((F.col("rn") > e) & (F.col("rn") <= e + size))) for e in edges]


def candidates(features, seed: int = 42) -> dict[str, Pipeline]:
    vector = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    scaled = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    plain = VectorAssembler(inputCols=list(features), outputCol="features")
    return {
        "logistic": Pipeline(stages=[vector, scaled, LogisticRegression(labelCol="churned", regParam=0.01)]),
        "random_forest": Pipeline(stages=[plain, RandomForestClassifier(labelCol="churned", numTrees=100, maxDepth=5, seed=seed)]),
        "gbt": Pipeline(stages=[plain, GBTClassifier(labelCol="churned", maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)]),
    }


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """user_id, churned (if known), p."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out.select("user_id", *[c for c in ("churned",) if c in rows.columns], "p")


def dummy_scores(rows: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """The stratified baseline: a class drawn at the base rate, by hash of the user."""
    u = F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.select("user_id", "churned", (u < rate).cast("double").alias("p"))


def average_precision(df: DataFrame, label: str = "label", score: str = "p") -> float:
    """Step-wise area under precision and recall, over counts of distinct scores."""
    by = df.groupBy(score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    rows = prefix_sums(by, [score], ["_p", "_n"])
    flagged = lambda c: F.col(f"{c}_all") - F.col(f"{c}_before")  # noqa: E731  (this score and higher ones)
    return one_row(rows, [(F.sum(F.col("_p") * flagged("_p") / flagged("_n")) / F.sum("_p")).alias("ap")])["ap"]


def evaluate(scored: DataFrame, label: str = "churned") -> dict[str, float]:
    p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    m = one_row(scored, [F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col(label), 2)).alias("brier"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy")])
    return {"roc_auc": auc(scored, label), "average_precision": average_precision(scored, label), **m}


def calibration_summary(scored: DataFrame, label: str = "churned", bins: int = 10) -> DataFrame:
    """bin, mean_pred, observed, n over equal bins of the observed range, right-closed with the lowest included."""
    lo, hi = scored.agg(F.min("p"), F.max("p")).first()
    width = max((hi - lo) / bins, 1e-12)
    k = F.least(F.greatest(F.ceil((F.col("p") - F.lit(lo)) / F.lit(width)).cast("int") - 1, F.lit(0)), F.lit(bins - 1))
    return scored.groupBy(k.alias("bin")).agg(F.avg("p").alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


@dataclass
class Trained:
    name: str
    model: PipelineModel
    features: tuple[str, ...]
    cv: dict[str, float]
    metrics: dict[str, float]
    importance: dict[str, float]
    n_users: int
    churn_rate: float


def train_pipeline(training: DataFrame, features, names: tuple[str, ...] | None = None, seed: int = 42) -> Trained:
    """Champion by mean AUC of temporal folds, refitted on the development rows and evaluated once on the holdout."""
    rows = settle(temporal_split(training))
    m = one_row(rows, [F.count(F.lit(1)).alias("n"), F.avg("churned").alias("rate")])
    if m["n"] < 100:
        raise ValueError("under 100 users")
    dev, hold = rows.where("part = 'dev'"), rows.where("part = 'holdout'")
    if any(part.select("churned").distinct().count() < 2 for part in (dev, hold)):
        raise ValueError("a part has one class only")
    usable = [(a, b) for a, b in folds(dev) if a.select("churned").distinct().count() == 2 and b.select("churned").distinct().count() == 2]
    if len(usable) < 2:
        raise ValueError("under two folds have both classes")
    made = {k: p for k, p in candidates(features, seed).items() if names is None or k in names}
    cv = {k: sum(auc(score(p.fit(a), b), "churned") for a, b in usable) / len(usable) for k, p in made.items()}
    name = max(cv, key=cv.get)
    model = made[name].fit(dev)
    last = model.stages[-1]
    weights = getattr(last, "featureImportances", None) if name != "logistic" else last.coefficients
    importance = dict(zip(features, [float(w) for w in weights.toArray()])) if weights is not None else {}
    return Trained(name, model, tuple(features), cv, evaluate(score(model, hold)), importance, m["n"], m["rate"])


def save_bundle(trained: Trained, path: str) -> dict:
    """Model, feature contract and card with the model's checksum under a folder of any file system; returns the card."""
    spark = SparkSession.active()
    trained.model.write().overwrite().save(f"{path}/model")
    files.write_text(spark, f"{path}/features.json", json.dumps(list(trained.features)))
    card = {"model": trained.name, "cv_roc_auc": trained.cv, "holdout": trained.metrics, "importance": trained.importance, "n_users": trained.n_users, "churn_rate": trained.churn_rate, "n_features": len(trained.features), "sha256": files.tree_sha256(spark, f"{path}/model")}
    files.write_text(spark, f"{path}/card.json", json.dumps(card, indent=1))
    return card


def load_bundle(path: str, features) -> tuple[PipelineModel, dict]:
    """The model, after its feature contract and checksum are verified."""
    spark = SparkSession.active()
    if json.loads(files.read_text(spark, f"{path}/features.json")) != list(features):
        raise ValueError("the feature contract differs")
    card = json.loads(files.read_text(spark, f"{path}/card.json"))
    if card.get("sha256") != files.tree_sha256(spark, f"{path}/model") or card.get("n_features") != len(features):
        raise ValueError("the model does not match its card")
    return PipelineModel.load(f"{path}/model"), card


def track(trained: Trained, tracker, artifacts: str, model: str = "churn", seed: int = 42) -> str:
    """Save the bundle, log the run (candidates' cross-validated AUC and the holdout's metrics) and register its version; the run's identifier."""
    card = save_bundle(trained, artifacts)
    metrics = {**{f"cv_roc_auc_{k}": v for k, v in trained.cv.items()}, **trained.metrics, "churn_rate": trained.churn_rate}
    run = tracker.log(model, {"champion": trained.name, "features": len(trained.features), "users": trained.n_users, "seed": seed}, metrics, {"sha256": card["sha256"]}, artifacts)
    tracker.register(model, run)
    return run


def predict_churn(model: PipelineModel, rows: DataFrame, features) -> DataFrame:
    """user_id, probability (6 digits), will_churn (at 0.5)."""
    if missing := set(features) - set(rows.columns):
        raise ValueError(f"missing features: {sorted(missing)}")
    p = F.round("p", 6)
    return score(model, rows).select("user_id", p.alias("probability"), (p >= 0.5).alias("will_churn"))
