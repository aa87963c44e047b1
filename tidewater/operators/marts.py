"""Staging projections and the star schema: users, transactions, daily channel mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stg_ad_spend_daily(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("date").cast("date"), F.col("channel").cast("string"), F.col("spend").cast("double"), F.col("impressions").cast("long"), F.col("clicks").cast("long"))


def stg_signups(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("user_id").cast("long"), F.col("signup_date").cast("date"), F.col("channel").cast("string"), F.col("subscribed").cast("boolean"), F.col("plan").cast("string"))


def stg_transactions(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("txn_id").cast("long"), F.col("user_id").cast("long"), F.col("txn_date").cast("date"), F.col("amount").cast("double"), F.col("is_fraud").cast("boolean"))


def dim_users(signups: DataFrame) -> DataFrame:
    return signups.select("user_id", "signup_date", "channel", F.col("subscribed").alias("is_paid"), "plan")


def fct_transactions(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """Transactions with their user's channel, plan and signup date; orphans are dropped. Users are merged, never broadcast."""
    u = users.select("user_id", F.col("channel").alias("acquisition_channel"), "plan", "signup_date")
    return transactions.join(u.hint("merge"), "user_id").select("txn_id", "user_id", "txn_date", "amount", "is_fraud", "acquisition_channel", "plan", "signup_date")


MEASURES = ("spend", "impressions", "clicks", "signups", "paid_signups", "txns", "revenue", "fraud_txns")


def mart_daily_channel(ad_spend: DataFrame, signups: DataFrame, fct: DataFrame) -> DataFrame:
    """One row for each (date, channel) that any source has.

    The three sources are stacked with zeros for the others' measures and summed once: one shuffle on (date, channel)
    instead of a distinct key spine and three left joins on it."""
    zero = {m: F.lit(0.0 if m in ("spend", "revenue") else 0).cast("double" if m in ("spend", "revenue") else "long") for m in MEASURES}

    def rows(df: DataFrame, date: str, channel: str, **own) -> DataFrame:
        return df.where(F.col(date).isNotNull() & F.col(channel).isNotNull()).select(F.col(date).alias("date"), F.col(channel).alias("channel"), *[own.get(m, zero[m]).alias(m) for m in MEASURES])

    one = F.lit(1).cast("long")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    parts = rows(ad_spend, "date", "channel", spend=F.col("spend"), impressions=F.col("impressions"), clicks=F.col("clicks"))
    parts = parts.unionByName(rows(signups, "signup_date", "channel", signups=one, paid_signups=flag("subscribed")))
    parts = parts.unionByName(rows(fct, "txn_date", "acquisition_channel", txns=one, revenue=F.col("amount"), fraud_txns=flag("is_fraud")))
    return parts.groupBy("date", "channel").agg(*[F.coalesce(F.sum(m), zero[m]).alias(m) for m in MEASURES])


def mart_daily_channel_joined(ad_spend: DataFrame, signups: DataFrame, fct: DataFrame) -> DataFrame:
    """The same mart by key spine (union distinct) and three left joins, for sources with one row for each key."""
    s = signups.groupBy(F.col("signup_date").alias("date"), "channel").agg(F.count(F.lit(1)).alias("signups"), F.count_if("subscribed").alias("paid_signups"))
    r = fct.groupBy(F.col("txn_date").alias("date"), F.col("acquisition_channel").alias("channel")).agg(F.count(F.lit(1)).alias("txns"), F.sum("amount").alias("revenue"), F.count_if("is_fraud").alias("fraud_txns"))
    keys = ["date", "channel"]
    spine = ad_spend.select(*keys).union(s.select(*keys)).union(r.select(*keys)).distinct()
    out = spine.join(ad_spend, keys, "left").join(s, keys, "left").join(r, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES])
