"""Queries of attribution, lifetime value, media mix and budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import marketing as m
from ..sources import adapters as a
from ..sources.adapters import Tables, with_views
from ..sources.settle import settle
from . import warehouse

TOUCHES = ("view", "click", "error", "signup")
PAID = ("automobile", "building", "furniture", "household")


def _ltv(s, d):
    t = Tables(s, d)
    tx = a.transactions(t)
    # subscribers without any transaction are left out, as the checked form would refuse them
    users = a.signups(t).join(tx.select("user_id").distinct(), "user_id", "left_semi")
    end = tx.agg(F.max("txn_date")).first()[0]
    return m.ltv_frames(users, tx, end)


def _markov(s, d):
    got = m.markov_removal(a.journeys(Tables(s, d)), TOUCHES)
    return s.createDataFrame([(k, round(v, 4)) for k, v in got.items()], "channel string, credit double")


def adstock_query(s, d):
    return adstock_channels(s, d, "channel = 'building'").drop("channel")


def adstock_channels(s, d, where="TRUE"):
    """The stock of every channel by date."""
    days = Window.partitionBy("channel").orderBy("date")  # a row for each day
    rows = settle(warehouse.mart(s, d).where(where).select("channel", "date", F.col("spend").alias("x"), (F.row_number().over(days) - 1).cast("long").alias("t")))
    return m.adstock_rows(rows, 0.5, ("channel",)).select("channel", "date", F.round("stock", 2).alias("stock"))


def _fit(s, d):
    spend, revenue, dow = m.daily_matrix(warehouse.mart(s, d), PAID)
    return m.fit_mmm(s, spend, revenue, dow, PAID, allow_negative=True), spend, revenue, dow


def mmm(s, d):
    fit, spend, _, _ = _fit(s, d)
    roas = fit.roas(spend)
    return s.createDataFrame([(c, float(fit.beta[k]), float(fit.decay[k]), float(fit.half_sat[k]), roas[c], fit.r2) for k, c in enumerate(fit.channels)], "channel string, beta double, decay double, half_sat double, roas double, r2 double")


def roas(s, d):
    fit, spend, revenue, dow = _fit(s, d)
    return m.bootstrap_roas(s, fit, spend, revenue, dow)


def budget(s, d):
    spend = warehouse.mart(s, d).where(F.col("channel").isin(*PAID)).groupBy("channel").agg(F.avg("spend").alias("x")).orderBy("channel").collect()
    responses = [m.ChannelResponse(r["channel"], 1000.0 * (k + 1), 0.1 * (k + 1), max(r["x"], 1.0)) for k, r in enumerate(spend)]
    got = m.optimal_allocation(responses, sum(r["x"] for r in spend))
    return s.createDataFrame([(k, round(v, 4)) for k, v in zip(got.channels, got.daily_spend)], "channel string, daily_spend double")


QUERIES = {
    "journeys": lambda s, d: a.journeys(Tables(s, d)).select("user_id", "segment", F.array_join("path", ">").alias("path"), "converted"),
    "last_touch": lambda s, d: m.last_touch(a.journeys(Tables(s, d))),
    "linear_touch": lambda s, d: m.linear_touch(a.journeys(Tables(s, d))).withColumn("credit", F.round("credit", 6)),
    "transitions": lambda s, d: m.transitions(a.journeys(Tables(s, d))),
    "markov_removal": _markov,
    "ltv_by_plan": lambda s, d: _ltv(s, d).plans.select("plan", "n_subscribers", *[F.round(c, 4).alias(c) for c in ("monthly_churn", "lifetime_months", "price", "ltv")]),
    "ltv_by_channel": lambda s, d: _ltv(s, d).by_channel.withColumn("avg_ltv", F.round("avg_ltv", 4)),
    "adstock": adstock_query,
    "adstock_channels": adstock_channels,
    "mmm_fit": mmm,
    "roas_bootstrap": roas,
    "budget_allocation": budget,
}

_LTV = """WITH e AS (SELECT max(txn_date) AS last FROM transactions), u AS (SELECT user_id, count(*) AS n, avg(amount) AS mean_amount FROM transactions GROUP BY 1),
    k AS (SELECT s.*, n, mean_amount, CAST(signup_date + CAST(n * 30 AS INTEGER) <= last AS INTEGER) AS churned FROM signups s JOIN u USING (user_id), e WHERE subscribed),
    p AS (SELECT plan, count(*) AS n_subscribers, sum(churned)::DOUBLE / nullif(sum(churned) + sum(n - 1), 0) AS h, avg(mean_amount) AS price FROM k WHERE plan IS NOT NULL GROUP BY 1)
    """
ORACLE = {
    "journeys": with_views("SELECT user_id, segment::BIGINT AS segment, array_to_string(path, '>') AS path, converted FROM journeys", "journeys"),
    "last_touch": with_views("SELECT path[-1] AS channel, count(*)::DOUBLE AS credit FROM journeys WHERE converted AND len(path) > 0 GROUP BY 1", "journeys"),
    "linear_touch": with_views("SELECT channel, round(sum(share), 6) AS credit FROM (SELECT unnest(path) AS channel, 1.0 / len(path) AS share FROM journeys WHERE converted) GROUP BY 1", "journeys"),
    "transitions": with_views(
        f"""WITH s AS (SELECT list_concat(list_concat(['{m.START}'], path), [CASE WHEN converted THEN '{m.CONVERTED}' ELSE '{m.LOST}' END]) AS s FROM journeys)
        SELECT src, dst, count(*) AS n FROM (SELECT unnest(s[:-2]) AS src, unnest(s[2:]) AS dst FROM s) GROUP BY 1, 2""",
        "journeys",
    ),
    "markov_removal": with_views(
        f"""WITH s AS (SELECT list_concat(list_concat(['{m.START}'], path), [CASE WHEN converted THEN '{m.CONVERTED}' ELSE '{m.LOST}' END]) AS s FROM journeys),
        c AS (SELECT src, dst, count(*) AS n FROM (SELECT unnest(s[:-2]) AS src, unnest(s[2:]) AS dst FROM s) GROUP BY 1, 2),
        p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c), gone AS (SELECT unnest(['', 'view', 'click', 'error', 'signup']) AS gone),
        r(k, gone, state, mass) AS (SELECT 0, gone, '{m.START}', 1.0::DOUBLE FROM gone
          UNION ALL SELECT k + 1, gone, dst, sum(mass * p) FROM r JOIN p ON r.state = p.src WHERE k < 500 AND dst <> gone GROUP BY k, gone, dst),
        v AS (SELECT gone, coalesce(sum(mass) FILTER (WHERE state = '{m.CONVERTED}'), 0.0) AS v FROM r GROUP BY 1),
        e AS (SELECT gone AS channel, greatest((SELECT v FROM v WHERE gone = '') - v, 0) AS e FROM v WHERE gone <> '')
        SELECT channel, round(e / (SELECT sum(e) FROM e) * (SELECT sum(n) FROM c WHERE dst = '{m.CONVERTED}'), 4) AS credit FROM e""",
        "journeys",
        recursive=True,
    ),
    "budget_allocation": with_views(
        f"""WITH x AS (SELECT channel, avg(spend) AS x, row_number() OVER (ORDER BY channel) AS k FROM mart WHERE channel IN {PAID} GROUP BY 1),
        q AS (SELECT channel, greatest(x, 1.0) * (1 - 0.1 * k) AS a, sqrt(1000.0 * k * greatest(x, 1.0) * (1 - 0.1 * k)) AS c, (SELECT sum(x) FROM x) AS b FROM x),
        f AS (SELECT *, (b + sum(a) OVER w) / sum(c) OVER w AS mu FROM q WINDOW w AS (ORDER BY c / a DESC ROWS UNBOUNDED PRECEDING)),
        mu AS (SELECT arg_min(mu, c / a) AS mu FROM f WHERE mu * c > a)
        SELECT channel, round(greatest(mu.mu * c - a, 0.0), 4) AS daily_spend FROM q, mu""",
        "mart",
    ),
    "adstock_channels": with_views(
        """WITH x AS (SELECT channel, date, spend, row_number() OVER (PARTITION BY channel ORDER BY date) AS t FROM mart),
        r(t, channel, date, stock) AS (SELECT t, channel, date, spend FROM x WHERE t = 1 UNION ALL SELECT x.t, x.channel, x.date, x.spend + 0.5 * r.stock FROM r JOIN x ON x.t = r.t + 1 AND x.channel = r.channel)
        SELECT channel, date, round(stock, 2) AS stock FROM r""",
        "mart",
        recursive=True,
    ),
    "ltv_by_plan": with_views(_LTV + "SELECT plan, n_subscribers, round(h, 4) AS monthly_churn, round(1 / h, 4) AS lifetime_months, round(price, 4) AS price, round(price / h, 4) AS ltv FROM p", "signups", "transactions"),
    "ltv_by_channel": with_views(_LTV + "SELECT channel, count(*) AS n_subscribers, round(avg(price / h), 4) AS avg_ltv FROM k JOIN p USING (plan) GROUP BY 1", "signups", "transactions"),
    "adstock": with_views(
        """WITH x AS (SELECT date, spend, row_number() OVER (ORDER BY date) AS t FROM mart WHERE channel = 'building'),
        r(t, date, stock) AS (SELECT t, date, spend FROM x WHERE t = 1 UNION ALL SELECT x.t, x.date, x.spend + 0.5 * r.stock FROM r JOIN x ON x.t = r.t + 1)
        SELECT date, round(stock, 2) AS stock FROM r""",
        "mart",
        recursive=True,
    ),
}
