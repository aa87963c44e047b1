"""Queries of the warehouse and the metric layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import marts, semantic
from ..sources import adapters as a
from ..sources.adapters import Tables, with_views

ALL = tuple(semantic.METRICS)
FILTERS = semantic.MetricFilters("building", dt.date(1995, 1, 1), dt.date(1997, 12, 31))


def mart(spark, d):
    t = Tables(spark, d)
    s = marts.stg_signups(a.signups(t))
    fct = marts.fct_transactions(marts.stg_transactions(a.transactions(t)), marts.dim_users(s))
    return marts.mart_daily_channel(marts.stg_ad_spend_daily(a.ad_spend_daily(t)), s, fct)


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def mart_joined(spark, d):
    t = Tables(spark, d)
    s = marts.stg_signups(a.signups(t))
    fct = marts.fct_transactions(marts.stg_transactions(a.transactions(t)), marts.dim_users(s))
    return _rounded(marts.mart_daily_channel_joined(marts.stg_ad_spend_daily(a.ad_spend_daily(t)), s, fct), 4)


def _metrics_sql(dims: str, where: str = "") -> str:
    def one(m):
        if m.denominator is None:
            return f"round(sum({m.numerator}), 4) AS {m.name}" if m.numerator in ("spend", "revenue") else f"CAST(sum({m.numerator}) AS BIGINT) AS {m.name}"
        return f"round(CAST(sum({m.numerator}) AS DOUBLE) / nullif(sum({m.denominator}), 0) + 1e-9, 6) AS {m.name}"

    cols = ", ".join(one(m) for m in semantic.METRICS.values())
    return with_views(f"SELECT {dims + ', ' if dims else ''}{cols} FROM mart {where} {'GROUP BY ' + dims if dims else ''}", "mart")


def _metrics(by=(), filters=None):
    def q(spark, d):
        df = semantic.compute_metrics(mart(spark, d), ALL, by, filters)
        # ratios of exact decimals can lie on a rounding tie; the nudge settles it alike in both engines
        return df.select(*[(F.round(c, 4) if c in ("spend", "revenue") else F.round(F.col(c) + 1e-9, 6)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])

    return q


def kpi_wow(spark, d):
    from ..operators.report import kpi_week_over_week

    return _rounded(kpi_week_over_week(mart(spark, d)), 4)


QUERIES = {
    "stg_ad_spend_daily": lambda s, d: _rounded(marts.stg_ad_spend_daily(a.ad_spend_daily(Tables(s, d))), 4),
    "stg_signups": lambda s, d: marts.stg_signups(a.signups(Tables(s, d))),
    "stg_transactions": lambda s, d: marts.stg_transactions(a.transactions(Tables(s, d))),
    "dim_users": lambda s, d: marts.dim_users(marts.stg_signups(a.signups(Tables(s, d)))),
    "fct_transactions": lambda s, d: marts.fct_transactions(a.transactions(Tables(s, d)), marts.dim_users(a.signups(Tables(s, d)))),
    "mart_daily_channel": lambda s, d: _rounded(mart(s, d), 4),
    "mart_daily_channel_joined": mart_joined,
    "metrics_total": _metrics(),
    "metrics_by_channel": _metrics(("channel",)),
    "metrics_by_date": _metrics(("date",)),
    "metrics_by_date_channel": _metrics(("date", "channel")),
    "metrics_filtered": _metrics(("channel",), FILTERS),
    "metrics_no_rows": _metrics((), semantic.MetricFilters("no such channel")),
    "metric_summary": lambda s, d: _rounded(semantic.compute_metrics(mart(s, d), ["spend", "signups", "paid_signups", "ctr", "cvr", "cac", "revenue"], ["channel"]), 4),
    "kpi_wow": kpi_wow,
    "warehouse_bounds": lambda s, d: a.transactions(Tables(s, d)).agg(F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), F.count(F.lit(1)).alias("n")),
}

_MART2 = "SELECT date, channel, round(spend, 4) AS spend, impressions, clicks, signups, paid_signups, txns, round(revenue, 4) AS revenue, fraud_txns FROM mart"
_KPIS = ("spend", "signups", "paid_signups", "revenue")
ORACLE = {
    "stg_ad_spend_daily": with_views("SELECT date, channel, round(spend, 4) AS spend, impressions, clicks FROM ad_spend_daily", "ad_spend_daily"),
    "stg_signups": with_views("SELECT * FROM signups", "signups"),
    "stg_transactions": with_views("SELECT * FROM transactions", "transactions"),
    "dim_users": with_views("SELECT user_id, signup_date, channel, subscribed AS is_paid, plan FROM signups", "signups"),
    "fct_transactions": with_views("SELECT txn_id, user_id, txn_date, amount, is_fraud, channel AS acquisition_channel, plan, signup_date FROM transactions JOIN signups USING (user_id)", "signups", "transactions"),
    "mart_daily_channel": with_views(_MART2, "mart"),
    "mart_daily_channel_joined": with_views(_MART2, "mart"),
    "metrics_total": _metrics_sql(""),
    "metrics_by_channel": _metrics_sql("channel"),
    "metrics_by_date": _metrics_sql("date"),
    "metrics_by_date_channel": _metrics_sql("date, channel"),
    "metrics_filtered": _metrics_sql("channel", "WHERE channel = 'building' AND date >= DATE '1995-01-01' AND date <= DATE '1997-12-31'"),
    "metrics_no_rows": _metrics_sql("", "WHERE channel = 'no such channel'"),
    "metric_summary": with_views(
        """SELECT channel, round(sum(spend), 4) AS spend, CAST(sum(signups) AS BIGINT) AS signups, CAST(sum(paid_signups) AS BIGINT) AS paid_signups, round(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 4) AS ctr,
        round(sum(signups)::DOUBLE / nullif(sum(clicks), 0), 4) AS cvr, round(sum(spend)::DOUBLE / nullif(sum(paid_signups), 0), 4) AS cac, round(sum(revenue), 4) AS revenue FROM mart GROUP BY channel""",
        "mart",
    ),
    "kpi_wow": with_views(
        "WITH b AS (SELECT max(date) AS m FROM mart), s AS (SELECT "
        + ", ".join(f"coalesce(sum({k}) FILTER (WHERE date > m - 7), 0)::DOUBLE AS {k}_c, coalesce(sum({k}) FILTER (WHERE date <= m - 7 AND date > m - 14), 0)::DOUBLE AS {k}_p" for k in _KPIS)
        + " FROM mart, b) "
        + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({k}_c, 4) AS current, round({k}_p, 4) AS previous, round(CASE WHEN {k}_p = 0 THEN 0.0 ELSE ({k}_c - {k}_p) / {k}_p END, 4) AS change FROM s" for k in _KPIS),
        "mart",
    ),
    "warehouse_bounds": with_views("SELECT min(txn_date) AS first_date, max(txn_date) AS last_date, count(*) AS n FROM transactions", "transactions"),
}
