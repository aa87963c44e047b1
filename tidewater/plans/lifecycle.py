"""Queries of what surrounds a model: landing, the scoring contract, tracked runs and their registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor, risk, serving, tracking
from ..sources import adapters as a
from ..sources import io
from ..sources.adapters import Tables, with_views
from ..sources.settle import shared_folder
from .forecast import _CHURN, SEGMENTS, training
from .marketing import PAID

#: A contract of four channels and tighter bounds, so that some rows of the supplied tables break it.
CONTRACT = serving.Contract(channels=PAID, bounds={**serving.BOUNDS, "total_spend_obs": ("double", 0, 300_000), "days_since_last_txn": ("long", 0, 100)})


def requests(s, d):
    """The churn features as scoring requests: names of channel and plan in place of their flags."""
    rows = training(s, d, 120, 30)
    name = lambda kind, levels: F.coalesce(*[F.when(F.col(f"{kind}_{x}") == 1, F.lit(x)) for x in levels]).alias(kind)
    return rows.select("user_id", name("channel", SEGMENTS), name("plan", ("basic", "pro")), *serving.NUMERIC)


def validated(s, d):
    got = serving.validate(requests(s, d), CONTRACT)
    return got.select("user_id", (F.size("reasons") == 0).alias("accepted"), F.array_join("reasons", ",").alias("reasons"))


def landed_tables(s, d):
    """Rows of every landed table, as published and read back."""
    t = Tables(s, d)
    path = shared_folder(s, "landed")
    io.land_tables({"ad_spend_daily": a.ad_spend_daily(t), "signups": a.signups(t), "transactions": a.transactions(t)}, path)
    counts = [io.scan(s, path, "raw", n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("ad_spend_daily", "signups", "transactions")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def tracked_runs(s, d):
    """Three ways to scale the events' scores, logged as runs; the best two are registered and the best one is promoted."""
    scores = a.scores(Tables(s, d))
    t = tracking.Tracker(s, shared_folder(s, "tracking"))
    for name, factor in (("plain", 1.0), ("half", 0.5), ("tenth", 0.1)):
        scaled = scores.withColumn("p", F.col("p") * factor)
        t.log("scores", {"factor": factor}, {"brier": risk.brier_score(scaled), "ece": monitor.calibration_check(scaled)["ece"]}, run_id=name)
    order = [r["run_id"] for r in t.runs("scores").orderBy(F.col("metrics")["brier"]).select("run_id").collect()]
    for run in order[1::-1]:
        t.move("scores", t.register("scores", run), "production")
    stages = s.createDataFrame([(v.run_id, v.version, v.stage) for v in t.versions("scores")], "run_id string, version long, stage string")
    runs = t.runs("scores").join(F.broadcast(stages), "run_id", "left")  # a row for each registered version
    return runs.select("run_id", F.col("params")["factor"].cast("double").alias("factor"), F.round(F.col("metrics")["brier"], 6).alias("brier"), F.round(F.col("metrics")["ece"], 6).alias("ece"), "version", "stage")


QUERIES = {"churn_requests": validated, "landed_tables": landed_tables, "tracked_runs": tracked_runs}
ORACLE = {
    "churn_requests": with_views(
        _CHURN.format(cut=120, total=150)
        + f"""SELECT user_id, len(r) = 0 AS accepted, array_to_string(r, ',') AS reasons FROM (SELECT user_id, list_concat(list_concat(
            CASE WHEN channel IN {PAID} THEN []::VARCHAR[] ELSE ['channel'] END, CASE WHEN total_amount <= 300000 THEN [] ELSE ['total_spend_obs'] END), CASE WHEN 120 - last_k <= 100 THEN [] ELSE ['days_since_last_txn'] END) AS r FROM g)""",
        "signups", "transactions", "ad_spend_daily",
    ),
    "landed_tables": with_views("SELECT 'signups' AS name, count(*) AS n FROM signups UNION ALL SELECT 'transactions', count(*) FROM transactions UNION ALL SELECT 'ad_spend_daily', count(*) FROM ad_spend_daily", "signups", "transactions", "ad_spend_daily"),
    "tracked_runs": with_views(
        """WITH f AS (SELECT unnest(['plain', 'half', 'tenth']) AS run_id, unnest([1.0, 0.5, 0.1])::DOUBLE AS factor), s AS (SELECT run_id, factor, label, p * factor AS p FROM scores, f),
        b AS (SELECT run_id, min(p) AS lo, greatest((max(p) - min(p)) / 10, 1e-12) AS w FROM s GROUP BY 1),
        c AS (SELECT s.run_id, least(greatest(ceil((p - lo) / w) - 1, 0), 9) AS bin, avg(p) AS m, avg(label) AS o, count(*) AS n FROM s JOIN b ON s.run_id = b.run_id GROUP BY 1, 2),
        e AS (SELECT run_id, sum(abs(m - o) * n) / sum(n) AS ece FROM c GROUP BY 1), r AS (SELECT run_id, factor, avg((p - label) ** 2) AS brier, row_number() OVER (ORDER BY avg((p - label) ** 2)) AS k FROM s GROUP BY 1, 2)
        SELECT run_id, factor, round(brier, 6) AS brier, round(ece, 6) AS ece, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 END::BIGINT AS version, CASE k WHEN 1 THEN 'production' WHEN 2 THEN 'archived' END AS stage FROM r JOIN e USING (run_id)""",
        "scores",
    ),
}
