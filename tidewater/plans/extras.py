"""Queries of the report, the simulator and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, marketing, report, sim
from ..sources import adapters as a
from ..sources import io
from ..sources.adapters import Tables, with_views
from ..streaming import metrics as streaming
from . import forecast, risk, warehouse


def review(s, d):
    t = Tables(s, d)
    got = report.build_weekly_review(warehouse.mart(s, d), a.signups(t), a.transactions(t))
    return s.createDataFrame([(k, f.unit, f.source) for k, f in got.figures.items()], "slug string, unit string, source string")


def review_values(s, d):
    """Every number of the weekly review."""
    t = Tables(s, d)
    got = report.build_weekly_review(warehouse.mart(s, d), a.signups(t), a.transactions(t))
    return s.createDataFrame([(k, i, round(v, 4)) for k, i, v in report.figure_values(got)], "slug string, item string, value double")


def simulated(s, d):
    out = sim.simulate(s)
    return out.signups.groupBy("channel").agg(F.count(F.lit(1)).alias("signups"), F.count_if("subscribed").alias("paid_signups"))


def event_windows(s, d):
    return streaming.windowed_counts(streaming.with_instants(Tables(s, d).events)).withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sessions(s, d):
    got = streaming.sessions(streaming.with_instants(Tables(s, d).events))
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def scenario_review(s, d):
    """True and estimated return of the media-mix scenario."""
    spend, revenue, dow, truth = sim.mmm_market()
    names = ("a", "b", "c", "d")
    fit = marketing.fit_mmm(s, spend, revenue, dow, names)
    got = fit.roas(spend)
    return s.createDataFrame([(c, float(truth["roas"][k]), got[c]) for k, c in enumerate(names)], "channel string, truth double, estimate double")


def causal_report(s, d=None):
    """Naive, causal and true effect of each simulated scenario."""
    (geo, a1), (cut, a2), (mail, a3), (price, a4) = ((s.createDataFrame(f), e) for f, e in (sim.geo_rollout(), sim.spend_threshold(), sim.promo_email(), sim.price_instrument()))
    over = cut.withColumn("over", (F.col("running") >= 0.3).cast("int"))
    rows = [
        ("geo rollout", "DiD", causal.naive_difference(geo.where("post"), "treated", "y"), causal.diff_in_diff(geo).att, a1),
        ("spend threshold", "sharp RDD", causal.naive_difference(over, "over", "outcome"), causal.sharp_rdd(cut, "running", "outcome", 0.3).effect, a2),
        ("promo email", "IPW", causal.naive_difference(mail, "treated", "outcome"), causal.ipw_ate(mail, ["engagement", "tenure"], "treated", "outcome").ate, a3),
        ("price change", "2SLS", causal.naive_ols_slope(price, "price", "demand"), causal.two_stage_least_squares(price, "instrument", "price", "demand").estimate, a4),
    ]
    return s.createDataFrame([(k, m, *map(float, v)) for k, m, *v in rows], "scenario string, method string, naive double, causal double, truth double")


def simulated_tables(s, truth=None):
    """The three raw tables of a simulated business."""
    out = sim.simulate(s, truth or sim.DEFAULT)
    return {"ad_spend_daily": out.ad_spend_daily, "signups": out.signups, "transactions": out.transactions}


def exported_market(s, path):
    """Fit the simulated media market and write its response parameters."""
    spend, revenue, dow, _ = sim.mmm_market()
    return io.export_mmm(marketing.fit_mmm(s, spend, revenue, dow, ("a", "b", "c", "d")), spend.mean(axis=0), path)


QUERIES = {"causal_report": causal_report, "weekly_review": review, "weekly_review_values": review_values, "simulated_signups": simulated, "event_windows": event_windows, "event_sessions": event_sessions, "mmm_scenario": scenario_review}
ORACLE = {
    "event_windows": "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), c AS (SELECT user_id, no, count(*) AS n FROM k GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "weekly_review_values": with_views(
        f"""WITH e AS (SELECT max(date) AS last FROM mart), days AS (SELECT date, sum(revenue) AS y FROM mart GROUP BY 1), revenue_series AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, date, y FROM days),
        late AS (SELECT m.*, date > last - 7 AS now FROM mart m, e WHERE date > last - 14),
        k AS (UNPIVOT (SELECT now, sum(spend)::DOUBLE AS spend, sum(signups)::DOUBLE AS signups, sum(paid_signups)::DOUBLE AS paid_signups, sum(revenue)::DOUBLE AS revenue FROM late GROUP BY 1) ON spend, signups, paid_signups, revenue INTO NAME metric VALUE v),
        w AS (SELECT metric, coalesce(max(v) FILTER (WHERE now), 0) AS cur, coalesce(max(v) FILTER (WHERE NOT now), 0) AS prev FROM k GROUP BY 1),
        c AS (UNPIVOT (SELECT channel, sum(spend)::DOUBLE AS spend, sum(signups)::DOUBLE AS signups, sum(paid_signups)::DOUBLE AS paid_signups, (sum(spend) / nullif(sum(paid_signups), 0))::DOUBLE AS cac, sum(revenue)::DOUBLE AS revenue FROM late WHERE now GROUP BY 1) ON spend, signups, paid_signups, cac, revenue INTO NAME metric VALUE v),
        u AS (SELECT user_id, count(*) AS n, avg(amount) AS mean_amount FROM transactions GROUP BY 1),
        sub AS (SELECT x.*, n, mean_amount, CAST(signup_date + CAST(n * 30 AS INTEGER) <= last AS INTEGER) AS churned FROM signups x LEFT JOIN u USING (user_id), e WHERE subscribed AND plan IS NOT NULL),
        p AS (SELECT plan, avg(mean_amount) * (sum(churned) + sum(n - 1)) / sum(churned) AS ltv FROM sub GROUP BY 1),
        l AS (SELECT channel, count(*)::DOUBLE AS n_subscribers, avg(ltv)::DOUBLE AS avg_ltv FROM sub JOIN p USING (plan) GROUP BY 1)
        SELECT 'kpi_' || metric AS slug, '' AS item, round(cur, 4) AS value FROM w
        UNION ALL SELECT 'kpi_' || metric || '_change', '', round(CASE WHEN prev = 0 THEN 0.0 ELSE (cur - prev) / prev END, 4) FROM w
        UNION ALL SELECT 'channels', channel || '.' || metric, round(v, 4) FROM c
        UNION ALL SELECT 'ltv', channel || '.n_subscribers', n_subscribers FROM l UNION ALL SELECT 'ltv', channel || '.avg_ltv', round(avg_ltv, 4) FROM l
        UNION ALL SELECT 'forecast_revenue', '', round(total, 4) FROM ({forecast._BEST.replace("WITH s AS", "WITH RECURSIVE s AS", 1)} SELECT sum(level + h * trend + season[(h - 1) % 7 + 1]) AS total FROM best, range(1, 15) x(h) WHERE t = (SELECT max(t) FROM s))
        UNION ALL SELECT 'anomalies', date::VARCHAR, round(score, 4) FROM ({risk._DEC}, g AS (SELECT median(residual) AS m FROM dec), h AS (SELECT 1.4826 * median(abs(residual - m)) AS sigma FROM dec, g)
            SELECT date, abs(residual) / sigma AS score FROM dec JOIN revenue_series USING (t), h WHERE abs(residual) / sigma > 5)""",
        "mart", "signups", "transactions",
    ),
}
