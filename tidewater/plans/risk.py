"""Queries of anomalies, score calibration, drift and monitoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import monitor, risk
from ..sources import adapters as a
from ..sources.adapters import Tables, with_views
from ..sources.settle import shared_folder
from ..streaming import latency
from .inference import one


def series(s, d):
    return a.revenue_series(Tables(s, d)).select(F.col("t").cast("long").alias("t"), "y")


def _requests(t: Tables):
    return t.events.select("event_id", "ts", F.col("event_type").alias("endpoint"), (F.col("value") / 1000).alias("latency"), (F.col("event_type") == "error").alias("error"))


def _halves(t: Tables):
    lines = t.lineitem.select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    early = F.year("l_shipdate") < 1998
    return lines.where(early), lines.where(~early)


def _psi(s, d):
    ref, cur = _halves(Tables(s, d))
    psi, status = risk.population_stability_index(ref, cur, "l_extendedprice")
    return one(s, psi=float(psi), status=status)


def _iso(s, d):
    return risk.isolation_forest_detector(s, series(s, d), 12)


def _calibration(s, d):
    r = monitor.calibration_check(a.scores(Tables(s, d)))
    return one(s, ece=float(r["ece"]), calibrated=r["calibrated"], n=r["n"])


def _fresh(s, d):
    r = monitor.data_freshness(a.transactions(Tables(s, d)), dt.datetime(2001, 1, 1))
    return one(s, hours=float(r["hours"]), fresh=r["fresh"])


def _drift(s, d):
    ref, cur = _halves(Tables(s, d))
    got = monitor.ks_drift(ref, cur, ["l_quantity", "l_extendedprice", "l_discount"])
    return got.withColumn("statistic", F.round("statistic", 6))


def _drift_profile(s, d):
    """The same check against a stored profile of the reference."""
    ref, cur = _halves(Tables(s, d))
    watch = monitor.DriftMonitor()
    watch.set_reference(ref)
    got = monitor.ks_drift_profile(watch.profile, cur, ["l_quantity", "l_extendedprice", "l_discount"])
    return got.withColumn("statistic", F.round("statistic", 6))


def latency_stream(s, d):
    """The latency report kept by a stateful stream over the events, fed in four batches of time."""
    folder = shared_folder(s, "latencies")
    _requests(Tables(s, d)).withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(f"{folder}/requests")
    rows = s.read.parquet(f"{folder}/requests")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/requests")
    latency.keep_latencies(stream, folder).awaitTermination()
    return _round(latency.latency_report(s, folder), 6)


def _round(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


QUERIES = {
    "decompose": lambda s, d: _round(risk.decompose(series(s, d)), 2),
    "mad_anomaly": lambda s, d: _round(risk.mad_scores(series(s, d)).drop("y"), 6),
    "isolation_forest": _iso,
    "auc": lambda s, d: one(s, auc=float(risk.auc(a.scores(Tables(s, d))))),
    "brier": lambda s, d: one(s, brier=float(risk.brier_score(a.scores(Tables(s, d))))),
    "reliability": lambda s, d: _round(risk.reliability_curve(a.scores(Tables(s, d))), 6),
    "ece": lambda s, d: one(s, ece=float(risk.expected_calibration_error(risk.reliability_curve(a.scores(Tables(s, d)))))),
    "cost_threshold": lambda s, d: risk.threshold_costs(a.scores(Tables(s, d)), 1.0, 10.0),
    "psi": _psi,
    "ks_drift": _drift,
    "ks_drift_profile": _drift_profile,
    "calibration_monitor": _calibration,
    "latency_percentiles": lambda s, d: _round(monitor.latency_report(_requests(Tables(s, d))), 6),
    "latency_stream": latency_stream,
    "throughput": lambda s, d: _round(monitor.throughput_report(_requests(Tables(s, d))), 6),
    "freshness": _fresh,
}

_DEC = """WITH s AS (SELECT t, y FROM revenue_series), b AS (SELECT min(t) AS lo, max(t) AS hi, arg_min(y, t) AS ylo, arg_max(y, t) AS yhi FROM s),
    p AS (SELECT t, y, FALSE AS pad FROM s UNION ALL SELECT lo - k, ylo, TRUE FROM b, range(1, 8) r(k) UNION ALL SELECT hi + k, yhi, TRUE FROM b, range(1, 8) r(k)),
    w AS (SELECT t, y, pad, quantile_cont(y, 0.5) OVER (ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS trend FROM p),
    q AS (SELECT t, y, trend FROM w WHERE NOT pad), k AS (SELECT t % 7 AS r, median(y - trend) AS weekly FROM q GROUP BY 1),
    dec AS (SELECT t, y, trend, weekly, y - trend - weekly AS residual FROM q JOIN k ON q.t % 7 = k.r)
    """
_HALVES = "WITH a AS (SELECT * FROM lineitem WHERE year(l_shipdate) < 1998), b AS (SELECT * FROM lineitem WHERE year(l_shipdate) >= 1998)"
_KS = []
for _c in ("l_quantity", "l_extendedprice", "l_discount"):
    _KS.append(
        f"SELECT '{_c}' AS \"column\", max(abs((SELECT avg(({_c} <= e)::INTEGER) FROM a) - (SELECT avg(({_c} <= e)::INTEGER) FROM b))) AS v FROM (SELECT unnest(quantile_cont({_c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM (SELECT {_c} FROM a UNION ALL SELECT {_c} FROM b))"
    )
ORACLE = {
    "decompose": with_views(_DEC + "SELECT t, round(y, 2) AS y, round(trend, 2) AS trend, round(weekly, 2) AS weekly, round(residual, 2) AS residual FROM dec", "revenue_series"),
    "mad_anomaly": with_views(
        _DEC + ", g AS (SELECT median(residual) AS m FROM dec), h AS (SELECT 1.4826 * median(abs(residual - m)) AS sigma FROM dec, g) SELECT t, round(abs(residual) / sigma, 6) AS score, abs(residual) / sigma > 5 AS flagged FROM dec, h",
        "revenue_series",
    ),
    "auc": with_views(
        """WITH r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM scores)
        SELECT round((sum(k) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1)::DOUBLE * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r""",
        "scores",
    ),
    "brier": with_views("SELECT round(avg((p - label) ** 2), 6) AS brier FROM scores", "scores"),
    "reliability": with_views("SELECT floor(p * 10)::INTEGER AS bin, round(avg(p), 6) AS mean_pred, round(avg(label), 6) AS observed, count(*) AS n FROM scores WHERE p < 1 GROUP BY 1", "scores"),
    "ece": with_views("WITH c AS (SELECT floor(p * 10) AS bin, avg(p) AS m, avg(label) AS o, count(*) AS n FROM scores WHERE p < 1 GROUP BY 1) SELECT round(sum(abs(m - o) * n) / sum(n), 6) AS ece FROM c", "scores"),
    "cost_threshold": with_views(
        """WITH c AS (SELECT DISTINCT round_even(p, 4) AS v FROM scores UNION SELECT 0.0 UNION SELECT 1.0), g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY p)
        SELECT v::DOUBLE AS threshold, 1.0::DOUBLE * coalesce(sum(neg) FILTER (WHERE p >= v), 0) + 10.0::DOUBLE * coalesce(sum(pos) FILTER (WHERE p < v), 0) AS cost FROM c, g GROUP BY v""",
        "scores",
    ),
    "psi": _HALVES
    + """, e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM a), k AS (SELECT unnest(range(0, 10)) AS bin),
        x AS (SELECT len(list_filter(q, lambda v: l_extendedprice >= v)) AS bin, count(*)::DOUBLE AS n FROM a, e GROUP BY 1), y AS (SELECT len(list_filter(q, lambda v: l_extendedprice >= v)) AS bin, count(*)::DOUBLE AS n FROM b, e GROUP BY 1),
        s AS (SELECT greatest(coalesce(x.n / (SELECT sum(n) FROM x), 0), 1e-6) AS ex, greatest(coalesce(y.n / (SELECT sum(n) FROM y), 0), 1e-6) AS ac FROM k LEFT JOIN x USING (bin) LEFT JOIN y USING (bin)),
        t AS (SELECT sum((ac - ex) * ln(ac / ex)) AS p FROM s) SELECT round(p, 6) AS psi, CASE WHEN p < 0.1 THEN 'stable' WHEN p < 0.25 THEN 'watch' ELSE 'alarm' END AS status FROM t""",
    "ks_drift": _HALVES + ' SELECT "column", round(v, 6) AS statistic, v > 0.1 AS drifted FROM (' + " UNION ALL ".join(_KS) + ")",
    "calibration_monitor": with_views(
        """WITH b AS (SELECT min(p) AS lo, greatest((max(p) - min(p)) / 10, 1e-12) AS w FROM scores), c AS (SELECT least(greatest(ceil((p - lo) / w) - 1, 0), 9) AS bin, avg(p) AS m, avg(label) AS o, count(*) AS n FROM scores, b GROUP BY 1)
        SELECT round(sum(abs(m - o) * n) / sum(n), 6) AS ece, sum(abs(m - o) * n) / sum(n) <= 0.05 AS calibrated, sum(n)::BIGINT AS n FROM c""",
        "scores",
    ),
    "latency_percentiles": """WITH r AS (SELECT event_type AS endpoint, value / 1000 AS latency, event_type = 'error' AS error, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
        l AS (SELECT endpoint, list(latency ORDER BY latency) FILTER (WHERE k <= 10000) AS v, count(*) AS n, avg(error::INTEGER) AS error_rate FROM r GROUP BY 1)
        SELECT endpoint, round(v[least(floor(len(v) * 0.5), len(v) - 1)::BIGINT + 1] * 1000, 2) AS p50, round(v[least(floor(len(v) * 0.95), len(v) - 1)::BIGINT + 1] * 1000, 2) AS p95, round(v[least(floor(len(v) * 0.99), len(v) - 1)::BIGINT + 1] * 1000, 2) AS p99, n, round(error_rate, 6) AS error_rate FROM l""",
    "throughput": "SELECT count(*) AS total, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS window_s, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS rps FROM events",
    "freshness": with_views("WITH m AS (SELECT greatest(0, (epoch(TIMESTAMP '2001-01-01') - epoch(CAST(max(txn_date) AS TIMESTAMP))) / 3600.0) AS h FROM transactions) SELECT round(h, 6)::DOUBLE AS hours, h <= 48 AS fresh FROM m", "transactions"),
}
ORACLE["latency_stream"] = ORACLE["latency_percentiles"]
ORACLE["ks_drift_profile"] = ORACLE["ks_drift"]
