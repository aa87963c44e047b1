"""Batch scoring under the churn serving contract: every request is scored or set aside with its reasons, in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .churn import CHANNELS, NUMERIC, PLANS, feature_names

#: The contract's kind and bounds of each number, both ends allowed.
BOUNDS: dict[str, tuple[str, float, float]] = {
    "user_id": ("long", 0, 2**63 - 1),
    "tenure_days": ("long", 0, 36_500),
    "txn_count_obs": ("long", 0, 1_000_000),
    "total_spend_obs": ("double", 0, 1_000_000_000),
    "avg_txn_amount_obs": ("double", 0, 1_000_000_000),
    "days_since_last_txn": ("long", 0, 36_500),
    "txn_freq_monthly": ("double", 0, 1_000_000),
    "had_fraud_obs": ("long", 0, 1),
    "signup_dow": ("long", 0, 6),
    "signup_month": ("long", 1, 12),
}


@dataclass(frozen=True)
class Contract:
    """Allowed channels and plans, and bounds of the numbers."""

    channels: tuple[str, ...] = CHANNELS
    plans: tuple[str, ...] = PLANS
    bounds: Mapping[str, tuple[str, float, float]] = field(default_factory=lambda: BOUNDS)

    @property
    def fields(self) -> tuple[str, ...]:
        return ("user_id", "channel", "plan", *NUMERIC)

    @property
    def features(self) -> tuple[str, ...]:
        return feature_names(self.channels, self.plans)


def _value(name: str, kind: str) -> Column:
    """The number in a column of any type; null where it holds none. A fraction is no whole number."""
    value = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    if kind == "double":
        return F.when(F.isnan(value), None).otherwise(value)
    whole = F.expr(f"try_cast(`{name}` AS BIGINT)")
    return F.when(value == F.floor(value), whole)


def validate(requests: DataFrame, contract: Contract | None = None) -> DataFrame:
    """The contract's fields as typed columns, and ``reasons``: the fields that break it, in its order; empty for a good row.

    A field breaks the contract if it is null, no number of its kind, not finite, or out of bounds. A column missing or unknown to the
    contract is refused for the whole frame."""
    contract = contract or Contract()
    if missing := [c for c in contract.fields if c not in requests.columns]:
        raise ValueError(f"missing fields: {missing}")
    if extra := [c for c in requests.columns if c not in contract.fields]:
        raise ValueError(f"unknown fields: {extra}")
    typed, bad = [], []
    for name in contract.fields:
        if name in contract.bounds:
            kind, low, high = contract.bounds[name]
            value = _value(name, kind)
            good = (value >= F.lit(low)) & (value <= F.lit(high))
        else:
            value = F.col(name).cast("string")
            good = value.isin(*(contract.channels if name == "channel" else contract.plans))
        typed.append(value.alias(name))
        bad.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)))
    return requests.select(*typed, F.array_compact(F.array(*bad)).alias("reasons"))


def encode(rows: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Validated rows with the model's features beside them; a set-aside row gets zeros, which no model refuses."""
    contract = contract or Contract()
    good = F.size("reasons") == 0
    numbers = {c: F.when(good, F.col(c)).otherwise(F.lit(0)).cast("double") for c in NUMERIC}
    flags = {f"channel_{c}": F.when(good & (F.col("channel") == c), 1).otherwise(0) for c in contract.channels}
    flags |= {f"plan_{p}": F.when(good & (F.col("plan") == p), 1).otherwise(0) for p in contract.plans}
    return rows.select("user_id", "reasons", *(v.alias(k) for k, v in {**numbers, **flags}.items()))


def score_batch(model: PipelineModel, requests: DataFrame, contract: Contract | None = None, version: str = "1", threshold: float = 0.5) -> DataFrame:
    """(user_id, churn_probability with 6 digits, churn_prediction, model_version, reasons): one row for each request.

    A row with reasons has no probability. Nothing is shuffled and the requests are read once."""
    contract = contract or Contract()
    out = model.transform(encode(validate(requests, contract), contract))
    p = F.when(F.size("reasons") == 0, vector_to_array("probability")[1])
    return out.select("user_id", F.round(p, 6).alias("churn_probability"), (p >= threshold).alias("churn_prediction"), F.lit(version).alias("model_version"), "reasons")


def split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rows set aside): write ``scored`` first, partitioned by ``size(reasons) > 0``, to read each part alone."""
    good = F.size("reasons") == 0
    return scored.where(good).drop("reasons"), scored.where(~good).select("user_id", "reasons")


def quarantine_report(scored: DataFrame) -> DataFrame:
    """(field, n): how many requests each field set aside."""
    return scored.select(F.explode("reasons").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
