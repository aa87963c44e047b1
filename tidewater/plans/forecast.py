"""Queries of forecasting and churn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn
from ..operators import forecasting as f
from ..sources import adapters as a
from ..sources.adapters import Tables, with_views
from ..sources.settle import settle
from . import warehouse

SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
FEATURES = churn.feature_names(SEGMENTS)


def total_series(s, d):
    return a.revenue_series(Tables(s, d)).select(F.lit("total").alias("key"), F.col("t").cast("long").alias("t"), "y")


def channel_series(s, d):
    """Revenue by channel and position; days without sales of a channel count as zero."""
    mart = warehouse.mart(s, d).where("revenue > 0")
    days = mart.groupBy("date").agg(*[F.sum(F.when(F.col("channel") == c, F.col("revenue")).otherwise(0.0)).alias(c) for c in SEGMENTS])
    from pyspark.sql import Window

    days = days.withColumn("t", F.row_number().over(Window.orderBy("date")).cast("long") - 1)  # one row for each day
    return days.unpivot("t", list(SEGMENTS), "key", "y").select("key", "t", "y")


def _round(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def training(s, d, cutoff=365, horizon=365):
    t = Tables(s, d)
    return churn.churn_features(a.signups(t), a.transactions(t), a.ad_spend_daily(t).select("date"), cutoff, horizon, SEGMENTS)


def split(s, d):
    rows = churn.temporal_split(training(s, d))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").cast("long").alias("churned"), F.min("signup_date").alias("first"), F.max("signup_date").alias("last"))


def model_scores(s, d):
    rows = settle(training(s, d))  # the joins run once, for the fits and for the scores
    got = churn.train_pipeline(rows, FEATURES)
    return churn.predict_churn(got.model, rows, FEATURES)


def model_metrics(s, d):
    got = churn.train_pipeline(settle(training(s, d)), FEATURES)
    return s.createDataFrame(sorted((k, float(v)) for k, v in got.metrics.items()), "metric string, value double")


def backtest(model, first=364, step=28):
    def q(s, d):
        return _round(f.backtest_metrics(f.backtest_rows(total_series(s, d), model, first, 14, step)), 4)

    return q


QUERIES = {
    "seasonal_naive": lambda s, d: _round(f.seasonal_naive_native(total_series(s, d), 14)),
    "holt_winters_grid": lambda s, d: f.holt_winters_grid(total_series(s, d)).select("alpha", "beta", "gamma", F.round(F.col("sse") / 1e12, 6).alias("sse")),
    "holt_winters": lambda s, d: _round(f.forecast(total_series(s, d), "holt_winters", 14), 2),
    "boosted_stumps": lambda s, d: f.forecast(total_series(s, d), "boosted_stumps", 14),
    "bottom_up": lambda s, d: _round(f.bottom_up_forecast(channel_series(s, d), "seasonal_naive", 14)),
    "backtest_naive": backtest("seasonal_naive"),
    "backtest_holt_winters": backtest("holt_winters"),
    "churn_features": lambda s, d: _round(training(s, d, 120, 30), 4),
    "temporal_split": split,
    "churn_model_scores": model_scores,
    "churn_model_metrics": model_metrics,
}

_CHURN = """WITH e AS (SELECT greatest((SELECT max(signup_date) FROM signups), (SELECT max(txn_date) FROM transactions), (SELECT max(date) FROM ad_spend_daily)) AS last),
    u AS (SELECT s.* FROM signups s, e WHERE subscribed AND plan IS NOT NULL AND signup_date + {total} <= last),
    r AS (SELECT u.*, txn_id, amount, is_fraud, date_diff('day', signup_date, txn_date) AS k FROM u LEFT JOIN transactions USING (user_id)),
    g AS (SELECT user_id, signup_date, channel, plan, count(txn_id) FILTER (WHERE k >= 0 AND k < {cut}) AS n_txns, coalesce(sum(amount) FILTER (WHERE k >= 0 AND k < {cut}), 0.0) AS total_amount,
      coalesce(avg(amount) FILTER (WHERE k >= 0 AND k < {cut}), 0.0) AS mean_amount, coalesce(max(amount) FILTER (WHERE k >= 0 AND k < {cut}), 0.0) AS max_amount,
      CAST(coalesce(bool_or(is_fraud) FILTER (WHERE k >= 0 AND k < {cut}), FALSE) AS INTEGER) AS any_fraud, coalesce(max(k) FILTER (WHERE k >= 0 AND k < {cut}), 0) AS last_k,
      CASE WHEN count(txn_id) FILTER (WHERE k >= {cut} AND k < {total}) = 0 THEN 1 ELSE 0 END AS churned FROM r GROUP BY 1, 2, 3, 4)
    """
# every grid point's state after each day; s0 is the season of the next day
_GRID = """WITH s AS (SELECT t, y FROM revenue_series), i AS (SELECT avg(y) FILTER (WHERE t < 7) AS l0, (avg(y) FILTER (WHERE t >= 7 AND t < 14) - avg(y) FILTER (WHERE t < 7)) / 7 AS b0, list(y ORDER BY t) FILTER (WHERE t < 7) AS y0 FROM s),
        grid AS (SELECT a, b, g FROM (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)) x(a), (VALUES (0.01::DOUBLE), (0.05), (0.1)) y(b), (VALUES (0.05::DOUBLE), (0.1), (0.3)) z(g)),
        r(t, a, b, g, level, trend, s0, s1, s2, s3, s4, s5, s6, sse) AS (
          SELECT -1::BIGINT, a, b, g, l0, b0, y0[1] - l0, y0[2] - l0, y0[3] - l0, y0[4] - l0, y0[5] - l0, y0[6] - l0, y0[7] - l0, 0.0::DOUBLE FROM grid, i
          UNION ALL
          SELECT s.t, a, b, g, a * (y - s0) + (1 - a) * (level + trend), b * (a * (y - s0) + (1 - a) * (level + trend) - level) + (1 - b) * trend, s1, s2, s3, s4, s5, s6,
            g * (y - (a * (y - s0) + (1 - a) * (level + trend))) + (1 - g) * s0, sse + CASE WHEN s.t >= 14 THEN (y - level - trend - s0) ** 2 ELSE 0 END
          FROM r JOIN s ON s.t = r.t + 1)"""
_BEST = _GRID + ", best AS (SELECT t, arg_min(level, sse) AS level, arg_min(trend, sse) AS trend, arg_min([s0, s1, s2, s3, s4, s5, s6], sse) AS season FROM r GROUP BY t)"
_ORIGINS = "o AS (SELECT unnest(range(364, count(*) - 13, 28)) AS o FROM s)"
# f: (o, h, y, forecast), e: (o, lower and upper quantile of the errors on the 28 days before)
_FOLDS = """, k AS (SELECT f.o, f.h, f.y, f.y - f.forecast AS d, f.y - n.y AS dn, q FROM f JOIN e ON e.o = f.o JOIN s n ON n.t = f.o - 7 + (f.h - 1) % 7)
    SELECT 'total' AS key, count(DISTINCT o) AS n_folds, round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)) / avg(abs(dn)), 4) AS mase,
    round(avg(greatest(0.1 * (d - q[1]), -0.9 * (d - q[1]))), 4) AS pinball_10, round(avg(greatest(0.5 * d, -0.5 * d)), 4) AS pinball_50, round(avg(greatest(0.9 * (d - q[2]), -0.1 * (d - q[2]))), 4) AS pinball_90 FROM k"""
ORACLE = {
    "holt_winters": with_views(_BEST + " SELECT 'total' AS key, h, round(level + h * trend + season[(h - 1) % 7 + 1], 2) AS forecast FROM best, range(1, 15) x(h) WHERE t = (SELECT max(t) FROM s)", "revenue_series", recursive=True),
    "backtest_naive": with_views(
        f"""WITH s AS (SELECT t, y FROM revenue_series), {_ORIGINS},
        f AS (SELECT o, h, a.y AS y, b.y AS forecast FROM o CROSS JOIN range(1, 15) x(h) JOIN s a ON a.t = o + h - 1 JOIN s b ON b.t = o - 7 + (h - 1) % 7),
        e AS (SELECT o, quantile_cont(a.y - b.y, [0.1, 0.9]) AS q FROM o CROSS JOIN range(1, 29) x(h) JOIN s a ON a.t = o - 29 + h JOIN s b ON b.t = o - 35 + (h - 1) % 7 GROUP BY o)
        {_FOLDS}""",
        "revenue_series",
    ),
    "backtest_holt_winters": with_views(
        f"""{_BEST}, {_ORIGINS},
        f AS (SELECT o, h, a.y AS y, level + h * trend + season[(h - 1) % 7 + 1] AS forecast FROM o CROSS JOIN range(1, 15) x(h) JOIN s a ON a.t = o + h - 1 JOIN best b ON b.t = o - 1),
        e AS (SELECT o, quantile_cont(a.y - (level + h * trend + season[(h - 1) % 7 + 1]), [0.1, 0.9]) AS q FROM o CROSS JOIN range(1, 29) x(h) JOIN s a ON a.t = o - 29 + h JOIN best b ON b.t = o - 29 GROUP BY o)
        {_FOLDS}""",
        "revenue_series",
        recursive=True,
    ),
    "seasonal_naive": with_views("WITH n AS (SELECT max(t) AS m FROM revenue_series) SELECT 'total' AS key, h, round(y, 4) AS forecast FROM revenue_series, n, range(1, 15) x(h) WHERE t > m - 7 AND (h - 1) % 7 = t - m + 6", "revenue_series"),
    "holt_winters_grid": with_views(
        _GRID + """ SELECT a AS alpha, b AS beta, g AS gamma, round(sse / 1e12, 6) AS sse FROM r WHERE t = (SELECT max(t) FROM s)""",
        "revenue_series",
        recursive=True,
    ),
    "bottom_up": with_views(
        """WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM mart WHERE revenue > 0)), c AS (SELECT unnest(['automobile', 'building', 'furniture', 'household', 'machinery']) AS key),
        s AS (SELECT c.key, d.t, coalesce(m.revenue, 0.0) AS y FROM c CROSS JOIN d LEFT JOIN mart m ON m.date = d.date AND m.channel = c.key), n AS (SELECT max(t) AS m FROM d),
        f AS (SELECT key, h, y AS forecast FROM s, n, range(1, 15) x(h) WHERE t > m - 7 AND (h - 1) % 7 = t - m + 6)
        SELECT key, h, round(forecast, 4) AS forecast FROM f UNION ALL SELECT 'total', h, round(sum(forecast), 4) FROM f GROUP BY h""",
        "mart",
    ),
    "churn_features": with_views(
        _CHURN.format(cut=120, total=150)
        + "SELECT user_id, signup_date, 120 AS tenure_days, n_txns AS txn_count_obs, round(total_amount, 4) AS total_spend_obs, round(mean_amount, 4) AS avg_txn_amount_obs, (120 - last_k)::INTEGER AS days_since_last_txn, round(n_txns / 4.0, 4) AS txn_freq_monthly, any_fraud AS had_fraud_obs, (isodow(signup_date) - 1)::INTEGER AS signup_dow, month(signup_date)::INTEGER AS signup_month, "
        + ", ".join(f"(channel = '{c}')::INTEGER AS channel_{c}" for c in SEGMENTS)
        + ", (plan = 'basic')::INTEGER AS plan_basic, (plan = 'pro')::INTEGER AS plan_pro, churned FROM g",
        "signups", "transactions", "ad_spend_daily",
    ),
    "temporal_split": with_views(
        _CHURN.format(cut=365, total=730)
        + ", o AS (SELECT *, row_number() OVER (ORDER BY signup_date, user_id) AS rn, count(*) OVER () AS n FROM g) SELECT CASE WHEN rn <= floor(n * 0.8) THEN 'dev' ELSE 'holdout' END AS part, count(*) AS n, sum(churned)::BIGINT AS churned, min(signup_date) AS first, max(signup_date) AS last FROM o GROUP BY 1",
        "signups", "transactions", "ad_spend_daily",
    ),
}
