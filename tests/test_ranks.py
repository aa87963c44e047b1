"""Running sums, exact quantiles and the normal distribution function against plain computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import ranks, stats
from tidewater.operators import experiments, marketing, monitor


def test_prefix_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"v": rng.choice(np.round(rng.normal(size=3000), 3), 5000), "n": rng.integers(1, 9, 5000)}).groupby("v", as_index=False).sum()
    got = ranks.prefix_sums(spark.createDataFrame(pdf), ["v"], ["n"]).orderBy("v").toPandas()
    assert (got["n_before"] == pdf["n"].cumsum() - pdf["n"]).all() and (got["n_all"] == pdf["n"].sum()).all()
    few = spark.createDataFrame([(None, 2), (1.0, 3), (float("inf"), 4)], "v double, n long")
    assert sorted((r["n"], r["n_before"]) for r in ranks.prefix_sums(few, ["v"], ["n"]).collect()) == [(2, 0), (3, 2), (4, 5)]
    assert ranks.prefix_sums(few.limit(0), ["v"], ["n"]).count() == 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.lognormal(size=20_000), "b": rng.choice([1.0, 2.0, 2.0, 7.0], 20_000), "c": np.where(rng.random(20_000) < 0.5, np.nan, rng.normal(size=20_000))})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))).withColumn("d", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ranks.exact_percentiles(df, ["a", "b", "c", "d"], shares)
    for c in "abc":
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), shares), rel=1e-12)
    assert got["d"] is None
    assert ranks.exact_percentiles(df.limit(0), ["a"], shares) == {"a": None}


def test_normal_cdf_column(spark):
    z = [*np.linspace(-9, 9, 601), -40.0, 40.0, 0.0]
    got = [r["p"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "i int, z double").select("i", stats.norm_cdf_column("z").alias("p")).orderBy("i").collect()]
    assert np.abs(np.array(got) - [stats.norm_cdf(v) for v in z]).max() < 5e-15
    odd = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(stats.norm_cdf_column("z").alias("p")).collect()
    assert odd[0]["p"] is None and math.isnan(odd[1]["p"])


def test_latest_requests_only(spark):
    rows = [("a" if i % 3 else None, i, i, float(i), i % 2 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "endpoint string, ts long, event_id long, latency double, error boolean")
    got = {r["endpoint"]: r for r in monitor.latency_report(df, keep_last=50).collect()}
    for name in ("a", None):
        last = sorted(i for i in range(900) if ("a" if i % 3 else None) == name)[-50:]
        assert got[name]["p50"] == last[25] * 1000 and got[name]["p99"] == last[49] * 1000
        assert got[name]["n"] == (600 if name else 300)


def test_allocation_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rs = [marketing.ChannelResponse(str(k), *map(float, (rng.uniform(1, 900), rng.uniform(0, 0.9), rng.uniform(1, 400)))) for k in range(5)]
        budget = float(rng.uniform(1, 500))
        best = marketing.optimal_allocation(rs, budget)
        assert sum(best.daily_spend) == pytest.approx(budget) and min(best.daily_spend) >= 0
        level = max(r.marginal(x) for r, x in zip(rs, best.daily_spend))
        assert all(r.marginal(x) == pytest.approx(level) for r, x in zip(rs, best.daily_spend) if x > 0)


def test_boundaries_spend_alpha():
    """A simulation of many paths leaves as often as each look may spend."""
    b = experiments.obf_boundaries(4, 0.1)
    z = np.cumsum(np.random.default_rng(4).normal(size=(400_000, 4)), axis=1) / np.sqrt(np.arange(1, 5))
    out = np.abs(z) > b
    first = np.where(out.any(axis=1), out.argmax(axis=1), 9)
    spent = [experiments.obf_spending(0.1, k / 4) for k in range(1, 5)]
    for k in range(4):
        share = np.diff([0, *spent])[k]
        assert abs((first == k).mean() - share) < 4 * math.sqrt(share / 400_000) + 1e-6
    assert experiments.obf_boundaries(30)[0] == 8.0
