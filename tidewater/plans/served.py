"""Queries over a landed warehouse: tables written and read back, metric SQL, and the tools on top of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import semantic, tools
from ..sources import adapters as a
from ..sources import files, io
from ..sources.adapters import Tables, with_views
from ..sources.settle import shared_folder
from . import forecast, marketing, warehouse

METRICS = ("spend", "signups", "cac", "ctr", "revenue")
WHERE = "channel <> 'building' AND date >= DATE '1996-01-01'"


_built: dict[tuple[str, str], str] = {}


def built(s, d) -> str:
    """A warehouse of the folder's tables, made once for each application: queries share it, as users of a warehouse do."""
    key = (s.sparkContext.applicationId, d)
    if key not in _built or not io.manifest(s, _built[key])[0]:
        t = Tables(s, d)
        _built[key] = shared_folder(s, "warehouse")
        io.build_all(s, {"ad_spend_daily": a.ad_spend_daily(t), "signups": a.signups(t), "transactions": a.transactions(t)}, _built[key])
    return _built[key]


def landed_counts(s, d):
    t = Tables(s, d)
    got = io.land_tables({"signups": a.signups(t), "transactions": a.transactions(t)}, shared_folder(s, "landed"))
    return s.createDataFrame(sorted(got.items()), "name string, n long")


def _ask(s, d, where=None, filters=None):
    """The metric layer's SQL text, run as it is over the mart."""
    if filters is None:
        sql, params = semantic.metric_query(METRICS, ("channel",), where), ()
    else:
        sql, params = semantic.parameterized_metric_query(METRICS, ("channel",), filters)
    name = f"mart_{uuid.uuid4().hex}"
    warehouse.mart(s, d).createOrReplaceTempView(name)
    got = s.sql(sql.replace(semantic.MART, name), args=list(params))
    return _figures(got)


def _figures(df):
    return df.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "bigint" else F.col(c) for c, k in df.dtypes])


def metrics_where(s, d):
    return _figures(semantic.compute_metrics(warehouse.mart(s, d), METRICS, ("channel",), where=WHERE))


def tool_metrics(s, d):
    got = tools.QueryGrowthMetricsTool(s, built(s, d)).run(METRICS, ("channel",), {"channel": "building", "start_date": "1995-01-01", "end_date": "1997-12-31"})
    rows = [(r["channel"], *(float(r[m]) for m in METRICS)) for r in got.data["rows"]]
    return s.createDataFrame(rows, "channel string, " + ", ".join(f"{m} double" for m in METRICS)).select("channel", *[F.round(m, 4).alias(m) for m in METRICS])


def tool_ltv(s, d):
    got = tools.LtvSummaryTool(s, built(s, d)).run()
    return s.createDataFrame([(r["plan"], r["n_subscribers"], r["ltv"]) for r in got.data["plans"]], "plan string, n_subscribers long, ltv double")


def tool_forecast(s, d):
    got = tools.ForecastRevenueTool(s, built(s, d)).run(14)
    return s.createDataFrame([(k, v) for k, v in enumerate(got.data["daily"], 1)], "h long, forecast double")


def tool_budget(s, d):
    """Plans over a written file of response parameters, as the exporter writes it."""
    spend = warehouse.mart(s, d).where(F.col("channel").isin(*marketing.PAID)).groupBy("channel").agg(F.avg("spend").alias("x")).orderBy("channel").collect()
    params = {r["channel"]: {"beta": 1000.0 * (k + 1), "decay": 0.1 * (k + 1), "half_sat": 100.0, "mean_spend": r["x"]} for k, r in enumerate(spend)}
    path = f"{shared_folder(s, 'params')}/mmm.json"
    files.write_text(s, path, json.dumps({"channels": params}))
    got = tools.BudgetPlannerTool(path).run(2000.0)
    return s.createDataFrame(sorted((k, float(v)) for k, v in got.data["plan"].items()), "channel string, daily_spend double")


def request_metrics(s, d):
    """The text exposition of the events' counters, one row for each line that counts."""
    text = io.PrometheusText()
    for r in Tables(s, d).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect():  # a closed set of types
        text.count[r["event_type"], 200] = r["n"]
    lines = [x for x in text.render().splitlines() if x.startswith("requests_total")]
    return s.createDataFrame([(x,) for x in lines], "line string")


def rows_as_json(s, d):
    rows = json.loads(io.rows_json(warehouse.mart(s, d).groupBy("channel").agg(F.min("date").alias("first"), F.sum("clicks").alias("clicks"))))
    return s.createDataFrame([(r["channel"], r["first"][:10], r["clicks"]) for r in rows], "channel string, first string, clicks long")


QUERIES = {
    "landed_counts": landed_counts,
    "landed_mart": lambda s, d: warehouse._rounded(io.scan(s, built(s, d), "marts", "mart_daily_channel"), 4),
    "metric_sql": lambda s, d: _ask(s, d),
    "metric_sql_where": lambda s, d: _ask(s, d, WHERE),
    "metric_sql_parameters": lambda s, d: _ask(s, d, filters=warehouse.FILTERS),
    "metrics_where": metrics_where,
    "tool_growth_metrics": tool_metrics,
    "tool_ltv_summary": tool_ltv,
    "tool_forecast_revenue": tool_forecast,
    "tool_plan_budget": tool_budget,
    "request_metrics": request_metrics,
    "rows_json": rows_as_json,
}


def _sql(where: str = "") -> str:
    return with_views(
        f"""SELECT channel, round(sum(spend), 4) AS spend, sum(signups)::BIGINT AS signups, round(sum(spend) / nullif(sum(paid_signups), 0), 4) AS cac,
        round(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 4) AS ctr, round(sum(revenue), 4) AS revenue FROM mart {where} GROUP BY channel""",
        "mart",
    )


_FILTERED = "WHERE channel = 'building' AND date >= DATE '1995-01-01' AND date <= DATE '1997-12-31'"
ORACLE = {
    "landed_counts": with_views("SELECT 'signups' AS name, count(*) AS n FROM signups UNION ALL SELECT 'transactions', count(*) FROM transactions", "signups", "transactions"),
    "landed_mart": with_views(warehouse._MART2, "mart"),
    "metric_sql": _sql(),
    "metric_sql_where": _sql(f"WHERE {WHERE}"),
    "metric_sql_parameters": _sql(_FILTERED),
    "metrics_where": _sql(f"WHERE {WHERE}"),
    "tool_growth_metrics": f"SELECT * REPLACE (signups::DOUBLE AS signups) FROM ({_sql(_FILTERED)})",
    "tool_ltv_summary": with_views(
        """WITH e AS (SELECT max(txn_date) AS last FROM transactions), u AS (SELECT user_id, count(*) AS n, avg(amount) AS mean_amount FROM transactions GROUP BY 1),
        k AS (SELECT plan, n, mean_amount, CAST(signup_date + CAST(n * 30 AS INTEGER) <= last AS INTEGER) AS churned FROM signups LEFT JOIN u USING (user_id), e WHERE subscribed AND plan IS NOT NULL)
        SELECT plan, count(*) AS n_subscribers, round(avg(mean_amount) * (sum(churned) + sum(n - 1)) / sum(churned), 4) AS ltv FROM k GROUP BY 1""",
        "signups", "transactions",
    ),
    "tool_forecast_revenue": with_views(
        "WITH days AS (SELECT date, sum(revenue) AS y FROM mart GROUP BY 1), revenue_series AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, y FROM days), "
        + forecast._BEST.lstrip()[5:] + " SELECT h, round(level + h * trend + season[(h - 1) % 7 + 1], 2) AS forecast FROM best, range(1, 15) x(h) WHERE t = (SELECT max(t) FROM s)",
        "mart",
        recursive=True,
    ),
    "tool_plan_budget": with_views(
        f"""WITH k AS (SELECT channel, row_number() OVER (ORDER BY channel) AS k FROM (SELECT DISTINCT channel FROM mart WHERE channel IN {marketing.PAID})),
        q AS (SELECT channel, 100.0 * (1 - 0.1 * k) AS a, sqrt(1000.0 * k * 100.0 * (1 - 0.1 * k)) AS c FROM k),
        f AS (SELECT *, (2000.0 + sum(a) OVER w) / sum(c) OVER w AS mu FROM q WINDOW w AS (ORDER BY c / a DESC ROWS UNBOUNDED PRECEDING)), mu AS (SELECT arg_min(mu, c / a) AS mu FROM f WHERE mu * c > a)
        SELECT channel, round(greatest(mu.mu * c - a, 0.0), 2) AS daily_spend FROM q, mu""",
        "mart",
    ),
    "request_metrics": """SELECT 'requests_total{route="' || event_type || '",status="200"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "rows_json": with_views("SELECT channel, min(date)::VARCHAR AS first, sum(clicks)::BIGINT AS clicks FROM mart GROUP BY 1", "mart"),
}
