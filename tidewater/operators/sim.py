"""Simulator of a subscription business with known parameters, and scenario generators with known effects.

Only tests and demonstrations import this module. Scenarios are model-sized numpy frames; the simulator itself draws in
tasks, seeded by (day, channel), so its output does not depend on partitions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import Truth, check_truth
from ..sources.settle import settle

DEFAULT = check_truth(
    Truth(
        start="2025-01-01",
        horizon_days=180,
        seed=42,
        dow=(1.0, 1.02, 1.04, 1.03, 1.1, 0.92, 0.89),
        channels={
            "search": {"impressions": 4000, "cpc": 0.8, "ctr": 0.05, "cvr": 0.06, "high_intent": 0.5},
            "social": {"impressions": 9000, "cpc": 0.5, "ctr": 0.02, "cvr": 0.04, "high_intent": 0.3},
            "display": {"impressions": 14000, "cpc": 0.3, "ctr": 0.01, "cvr": 0.02, "high_intent": 0.15},
            "video": {"impressions": 6000, "cpc": 0.6, "ctr": 0.015, "cvr": 0.03, "high_intent": 0.25},
            "organic": {"impressions": 0, "signups": 12, "high_intent": 0.55},
        },
        plans={"basic": {"price": 10.0, "churn": 0.12, "share": 0.7}, "pro": {"price": 25.0, "churn": 0.07, "share": 0.3}},
        subscribe={"high": 0.45, "low": 0.12},
        fraud_rate=0.02,
    )
)


def expected_signup_rate(truth: Truth, channel: str) -> float:
    """Signups per impression of a paid channel."""
    c = truth.channels[channel]
    return c["ctr"] * c["cvr"]


def expected_trial_to_paid(truth: Truth, channel: str) -> float:
    h = truth.channels[channel]["high_intent"]
    return h * truth.subscribe["high"] + (1 - h) * truth.subscribe["low"]


@dataclass(frozen=True)
class SimOutput:
    ad_spend_daily: DataFrame
    signups: DataFrame
    transactions: DataFrame
    users_latent: DataFrame


def simulate(spark: SparkSession, truth: Truth = DEFAULT) -> SimOutput:
    """Impressions, clicks and signups by day and channel; subscriptions, geometric lifetimes and 30-day bills by user."""
    start, names = dt.date.fromisoformat(truth.start), list(truth.channels)
    days = spark.range(truth.horizon_days * len(names)).select(F.floor(F.col("id") / len(names)).alias("day"), (F.col("id") % len(names)).alias("c"))

    def traffic(batches):
        for pdf in batches:
            rows = []
            for day, c in zip(pdf["day"], pdf["c"]):
                rng = np.random.default_rng([truth.seed, int(day), int(c)])
                p, date = truth.channels[names[c]], start + dt.timedelta(days=int(day))
                m = truth.dow[date.weekday()]
                shown = int(rng.poisson(p["impressions"] * m)) if p["impressions"] else 0
                clicks = int(rng.binomial(shown, p["ctr"])) if shown else 0
                joined = int(rng.binomial(clicks, p["cvr"])) if shown else int(rng.poisson(p.get("signups", 0) * m))
                rows.append((int(day), names[c], date, clicks * p.get("cpc", 0.0), shown, clicks, joined))
            yield pd.DataFrame(rows, columns=["day", "channel", "date", "spend", "impressions", "clicks", "joined"])

    made = days.mapInPandas(traffic, "day long, channel string, date date, spend double, impressions long, clicks long, joined long")
    made = settle(made)
    ads = made.where("impressions > 0").select("date", "channel", "spend", "impressions", "clicks")
    from pyspark.sql import Window

    before = F.coalesce(F.sum("joined").over(Window.orderBy("day", "channel").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each day and channel
    users = made.withColumn("first", before).where("joined > 0").select("day", "channel", F.explode(F.expr("sequence(first, first + joined - 1)")).alias("user_id"))
    plan_names = list(truth.plans)

    def people(batches):
        for pdf in batches:
            rows = []
            for day, channel, user in zip(pdf["day"], pdf["channel"], pdf["user_id"]):
                rng = np.random.default_rng([truth.seed, 1_000_003, int(user)])
                high = rng.random() < truth.channels[channel]["high_intent"]
                paid = rng.random() < truth.subscribe["high" if high else "low"]
                plan = plan_names[int(rng.random() >= truth.plans[plan_names[0]]["share"])] if paid else None
                months = int(rng.geometric(truth.plans[plan]["churn"])) if paid else 0
                rows.append((int(user), int(day), channel, bool(high), bool(paid), plan, months))
            yield pd.DataFrame(rows, columns=["user_id", "day", "channel", "high", "subscribed", "plan", "months"])

    found = users.mapInPandas(people, "user_id long, day long, channel string, high boolean, subscribed boolean, plan string, months long")
    found = settle(found)
    date = F.date_add(F.lit(start), F.col("day").cast("int"))
    signups = found.select("user_id", date.alias("signup_date"), "channel", "subscribed", "plan")
    bills = found.where("subscribed").select("user_id", "plan", "day", F.posexplode(F.expr("sequence(1L, months)")).alias("k", "_m")).where((F.col("day") + 30 * F.col("k")) < truth.horizon_days)
    price = F.lit(None).cast("double")
    for name, p in truth.plans.items():
        price = F.when(F.col("plan") == name, F.lit(p["price"])).otherwise(price)
    u = F.pmod(F.xxhash64("user_id", "k", F.lit(truth.seed)), F.lit(1_000_000)) / 1_000_000
    transactions = bills.select(
        (F.col("user_id") * 1000 + F.col("k")).alias("txn_id"), "user_id", F.date_add(F.lit(start), (F.col("day") + 30 * F.col("k")).cast("int")).alias("txn_date"), price.alias("amount"), (u < truth.fraud_rate).alias("is_fraud")
    )
    latent = found.select("user_id", F.col("high").alias("latent_high_intent"), "subscribed", "plan", F.col("months").alias("lifetime_months"))
    return SimOutput(ads, signups, transactions, latent)


# -- scenarios: (frame, true effect) --------------------------------------------------------------------------------


def geo_rollout(seed: int = 0, geos: int = 60, days: int = 120, effect: float = 0.008, broken: bool = False) -> tuple[pd.DataFrame, float]:
    rng = np.random.default_rng(seed)
    g, t = np.repeat(np.arange(geos), days), np.tile(np.arange(days), geos)
    treated, post = g < geos // 2, t >= days // 2
    y = 0.1 + rng.normal(0, 0.02, geos)[g] + 0.015 * treated + 0.00005 * t + effect * (treated & post) + rng.normal(0, 0.004, len(g))
    if broken:
        y = y + 0.0004 * t * treated
    return pd.DataFrame({"unit": g, "time": t, "treated": treated, "post": post, "y": y}), effect


def spend_threshold(seed: int = 1, n: int = 8000, effect: float = 0.15, broken: bool = False) -> tuple[pd.DataFrame, float]:
    rng = np.random.default_rng(seed)
    x = rng.normal(0.3, 0.4, n)
    if broken:
        near = (x < 0.3) & (x > 0.25) & (rng.random(n) < 0.7)
        x = np.where(near, 0.3 + rng.uniform(0, 0.04, n), x)
    return pd.DataFrame({"running": x, "outcome": 0.5 + 0.8 * (x - 0.3) + effect * (x >= 0.3) + rng.normal(0, 0.2, n)}), effect


def promo_email(seed: int = 2, n: int = 6000, effect: float = 0.06, broken: bool = False) -> tuple[pd.DataFrame, float]:
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    d = rng.random(n) < 1 / (1 + np.exp(-(8 if broken else 0.8) * a - 0.4 * b))
    y = rng.random(n) < np.clip(0.35 + 0.08 * a + 0.03 * b + effect * d, 0.01, 0.99)
    return pd.DataFrame({"engagement": a, "tenure": b, "treated": d.astype(int), "outcome": y.astype(int)}), effect


def price_instrument(seed: int = 3, n: int = 6000, effect: float = -0.4, broken: bool = False) -> tuple[pd.DataFrame, float]:
    rng = np.random.default_rng(seed)
    z, u = rng.normal(0, 1, n), rng.normal(0, 1, n)
    x = (0.002 if broken else 0.5) * z + 1.5 * u + rng.normal(0, 0.5, n)
    return pd.DataFrame({"instrument": z, "price": x, "demand": effect * x + 3 * u + rng.normal(0, 0.5, n)}), effect


def mmm_market(seed: int = 4, days: int = 600) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(spend, revenue, weekday, truth) of four channels with adstock and saturation."""
    from .marketing import adstock, saturate

    rng, k = np.random.default_rng(seed), 4
    beta, decay, half = np.array([900.0, 700.0, 500.0, 800.0]), np.array([0.3, 0.5, 0.2, 0.6]), np.array([150.0, 200.0, 120.0, 300.0])
    spend = np.maximum(rng.gamma(2.0, 60.0, (days, k)) * (rng.random((days, k)) < 0.75), 0)
    dow = np.arange(days) % 7
    parts = np.column_stack([beta[j] * saturate(adstock(spend[:, j], decay[j]), half[j]) for j in range(k)])
    revenue = 2000 + np.array([0, 40, 60, 50, 120, -60, -90])[dow] + parts.sum(axis=1) + rng.normal(0, 40, days)
    return spend, revenue, dow, {"beta": beta, "decay": decay, "half_sat": half, "roas": parts.sum(axis=0) / spend.sum(axis=0)}


def daily_series(seed: int = 6, days: int = 600, shocks: int = 12) -> tuple[pd.DataFrame, np.ndarray]:
    """(t, y) with trend, season and shocks; the shock days."""
    rng, t = np.random.default_rng(seed), np.arange(days)
    y = 1000 + 0.15 * t + np.array([0, 30, 50, 40, 120, -60, -110])[t % 7] + rng.normal(0, 20, days)
    at = np.sort(rng.choice(np.arange(30, days - 10), shocks, replace=False)) if shocks else np.zeros(0, int)
    y[at] += rng.choice([-1, 1], len(at)) * rng.uniform(250, 400, len(at))
    return pd.DataFrame({"t": t, "y": y}), at


def fraud_transactions(seed: int = 7, n: int = 30_000, shifted: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    a, v = rng.normal(0, 1, n), rng.gamma(2, 1, n) * (1.6 if shifted else 1.0)
    c, night = (rng.random(n) < 0.08).astype(float), (rng.random(n) < 0.25).astype(float)
    p = 1 / (1 + np.exp(-(-4.6 + 0.7 * a + 0.5 * v + 1.6 * c + 0.6 * night)))
    return pd.DataFrame({"amount_z": a, "velocity": v, "country_mismatch": c, "night": night, "is_fraud": (rng.random(n) < p).astype(int)})


def journey_paths(seed: int = 5, n: int = 20_000) -> tuple[pd.DataFrame, dict[str, float]]:
    """Journeys where display shows up late but converts little; the conversions that each channel adds."""
    rng = np.random.default_rng(seed)
    names, lift = ("search", "social", "display", "video"), {"search": 0.12, "social": 0.06, "display": 0.005, "video": 0.04}
    rows, added = [], dict.fromkeys(names, 0.0)
    for _ in range(n):
        path = [names[k] for k in rng.choice([0, 1, 3], rng.integers(1, 4))]
        if rng.random() < 0.6:
            path.append("display")
        p = 0.01 + sum(lift[c] for c in set(path))
        got = bool(rng.random() < p)
        if got:
            for c in set(path):
                added[c] += lift[c] / p
        rows.append((path, got))
    return pd.DataFrame(rows, columns=["path", "converted"]), added
