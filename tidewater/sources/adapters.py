"""Views of the supplied parquet as the engine's raw tables; timestamps become dates here.

Tables with a row for each user or order are merged, never broadcast: their files are far smaller than their rows, which a broadcast gathers on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazy parquet scans of one directory; Catalyst prunes columns and pushes filters into each."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def signups(t: Tables) -> DataFrame:
    """user_id, signup_date (first order), channel, subscribed, plan (null unless subscribed)."""
    first = t.orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("signup_date"))
    subscribed = F.col("c_acctbal") >= 0
    plan = F.when(subscribed, F.when(F.col("c_nationkey") % 2 == 0, "pro").otherwise("basic"))
    rows = t.customer.join(first.hint("merge"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_custkey").alias("user_id"), "signup_date", F.lower("c_mktsegment").alias("channel"), subscribed.alias("subscribed"), plan.alias("plan"))


def transactions(t: Tables) -> DataFrame:
    """txn_id, user_id, txn_date, amount, is_fraud: the orders of subscribed users."""
    users = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    fraud = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return t.orders.join(users.hint("merge"), "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("txn_date"), F.col("o_totalprice").alias("amount"), fraud.alias("is_fraud")
    )


def ad_spend_daily(t: Tables) -> DataFrame:
    """date, channel, spend, impressions, clicks by ship date; one segment stands in for organic traffic."""
    lines = t.lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_discount", "l_quantity")
    who = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", F.lower("c_mktsegment").alias("channel")).hint("merge"), F.col("o_custkey") == F.col("c_custkey")).where("channel <> 'machinery'")
    rows = lines.join(who.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("date", "channel").agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"), F.sum("l_quantity").cast("long").alias("impressions"), F.count(F.lit(1)).alias("clicks")
    )


def journeys(t: Tables) -> DataFrame:
    """user_id, segment, path, converted: events of a user in order, cut after each purchase."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.col("event_type") == "purchase"
    e = e.withColumn("segment", F.coalesce(F.sum(bought.cast("int")).over(before), F.lit(0)))
    step = F.struct("ts", "event_id", "event_type")
    touches = F.sort_array(F.collect_list(F.when(~bought, step)))
    return e.groupBy("user_id", "segment").agg(F.transform(touches, lambda x: x["event_type"]).alias("path"), F.bool_or(bought).alias("converted"))


def scores(t: Tables) -> DataFrame:
    """event_id, label (0/1), p in [0, 1]."""
    return t.events.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"))


PANEL_POST = "1998-01-01"


def panel(t: Tables) -> DataFrame:
    """unit (nation), time (month number), y (mean order), treated (odd nation), post (from a fixed month)."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = t.orders.join(t.customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("unit"), month.alias("time"), "o_totalprice", (F.col("c_nationkey") % 2 == 1).alias("treated"))
    split = int(PANEL_POST[:4]) * 12 + int(PANEL_POST[5:7])
    return rows.groupBy("unit", "time").agg(F.avg("o_totalprice").alias("y"), F.bool_or("treated").alias("treated")).withColumn("post", F.col("time") >= split)


def iv_rows(t: Tables) -> DataFrame:
    exposure = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(F.col("l_discount").alias("z"), exposure.alias("x"), (exposure * (1 + F.col("l_tax"))).alias("y"))


def rdd_rows(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("outcome"))
    return t.customer.join(spent.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_acctbal").alias("running"), "outcome")


def ipw_rows(t: Tables) -> DataFrame:
    """x (0/1), d (treated), y (0/1) of each customer with orders."""
    failed = t.orders.groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("y"))
    return t.customer.join(failed.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).select(
        (F.col("c_nationkey") < 12).cast("double").alias("x"), F.col("c_mktsegment").isin("BUILDING", "FURNITURE").cast("int").alias("d"), "y"
    )


def revenue_series(t: Tables) -> DataFrame:
    """t (position), date, y: order value by date. One row for each date, so the window is small."""
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("y"))
    return days.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)


#: The same views in DuckDB's dialect.
SQL = {
    "signups": """SELECT c.c_custkey AS user_id, f.d AS signup_date, lower(c.c_mktsegment) AS channel, c.c_acctbal >= 0 AS subscribed,
        CASE WHEN c.c_acctbal >= 0 THEN CASE WHEN c.c_nationkey % 2 = 0 THEN 'pro' ELSE 'basic' END END AS plan
        FROM customer c JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) f ON f.o_custkey = c.c_custkey""",
    "transactions": """SELECT o_orderkey AS txn_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS txn_date, o_totalprice AS amount,
        (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS is_fraud
        FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
    "ad_spend_daily": """SELECT CAST(l_shipdate AS DATE) AS date, lower(c_mktsegment) AS channel, sum(l_extendedprice * l_discount) AS spend,
        CAST(sum(l_quantity) AS BIGINT) AS impressions, count(*) AS clicks
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE lower(c_mktsegment) <> 'machinery' GROUP BY 1, 2""",
    "signup_agg": "SELECT signup_date AS date, channel, count(*) AS signups, count(*) FILTER (WHERE subscribed) AS paid_signups FROM signups GROUP BY 1, 2",
    "rev_agg": "SELECT t.txn_date AS date, s.channel, count(*) AS txns, sum(t.amount) AS revenue, count(*) FILTER (WHERE t.is_fraud) AS fraud_txns FROM transactions t JOIN signups s USING (user_id) GROUP BY 1, 2",
    "mart": """SELECT k.date, k.channel, coalesce(a.spend, 0.0) AS spend, coalesce(a.impressions, 0) AS impressions, coalesce(a.clicks, 0) AS clicks,
        coalesce(s.signups, 0) AS signups, coalesce(s.paid_signups, 0) AS paid_signups, coalesce(r.txns, 0) AS txns, coalesce(r.revenue, 0.0) AS revenue, coalesce(r.fraud_txns, 0) AS fraud_txns
        FROM (SELECT date, channel FROM ad_spend_daily UNION SELECT date, channel FROM signup_agg UNION SELECT date, channel FROM rev_agg) k
        LEFT JOIN ad_spend_daily a USING (date, channel) LEFT JOIN signup_agg s USING (date, channel) LEFT JOIN rev_agg r USING (date, channel)""",
    "journeys": """SELECT user_id, segment, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE event_type <> 'purchase'), []) AS path, bool_or(event_type = 'purchase') AS converted
        FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM events)
        GROUP BY 1, 2""",
    "scores": "SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS label, least(value / 500, 1.0) AS p FROM events",
    "panel": f"""SELECT c_nationkey AS unit, year(o_orderdate) * 12 + month(o_orderdate) AS time, avg(o_totalprice) AS y, c_nationkey % 2 = 1 AS treated,
        year(o_orderdate) * 12 + month(o_orderdate) >= {int(PANEL_POST[:4]) * 12 + int(PANEL_POST[5:7])} AS post
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "iv_rows": "SELECT l_discount AS z, l_extendedprice * (1 - l_discount) AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem",
    "rdd_rows": "SELECT c_acctbal AS running, outcome FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS outcome FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "ipw_rows": """SELECT CAST(c_nationkey < 12 AS DOUBLE) AS x, CAST(c_mktsegment IN ('BUILDING', 'FURNITURE') AS INTEGER) AS d, y
        FROM customer JOIN (SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS y FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "revenue_series": "SELECT row_number() OVER (ORDER BY date) - 1 AS t, date, y FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS y FROM orders GROUP BY 1)",
}
_NEEDS = {"signup_agg": ("signups",), "rev_agg": ("signups", "transactions"), "mart": ("ad_spend_daily", "signup_agg", "rev_agg")}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the named views and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    rest = body.lstrip()
    joined = f"{head},\n{rest[5:]}" if rest[:5].upper() == "WITH " else f"{head}\n{rest}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
