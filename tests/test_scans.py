"""Recurrences done as shared scans, against the plain recurrence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import forecasting as f
from tidewater.operators import marketing as m


def series(n, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + 0.1 * t + 10 * np.sin(t * 2 * np.pi / 7) + r.normal(0, 3, n)


def test_prefix_fits_equal_refits():
    y = series(300)
    ends = [5, 20, 21, 50, 51, 160, 299, 300]
    for make in (f.HoltWinters, f.SeasonalNaive):
        got = f.fit_prefixes(make, y, ends)
        for e in ends:
            try:
                want = make().fit(y[:e]).predict(10)
            except ValueError:
                assert got[e] is None
            else:
                assert np.allclose(got[e].predict(10), want, rtol=1e-12)
                if make is f.HoltWinters:
                    assert got[e].params == make().fit(y[:e]).params


def test_backtest_equals_independent_folds(spark):
    """A model without a scan of its own takes the row-per-fold path; both give the same folds."""

    class Plain:
        def fit(self, y):
            self.inner = f.HoltWinters().fit(y)
            return self

        def predict(self, horizon):
            return self.inner.predict(horizon)

    rows = [(k, t, float(v)) for k, n in (("a", 220), ("b", 130), ("short", 40)) for t, v in enumerate(series(n, len(k)))]
    df = spark.createDataFrame(rows, "key string, t long, y double")
    shared = f.backtest_rows(df, "holt_winters", 60, 14, 28).toPandas()
    apart = f.backtest_rows(df, Plain, 60, 14, 28).toPandas()
    by = ["key", "origin", "h"]
    pd.testing.assert_frame_equal(shared.sort_values(by, ignore_index=True), apart.sort_values(by, ignore_index=True))
    assert set(shared["key"]) == {"a", "b"}


@pytest.mark.parametrize("decay", [0.0, 1e-6, 0.3, 0.5, 0.95, 0.9999])
def test_adstock_scan_equals_the_recurrence(spark, monkeypatch, decay):
    monkeypatch.setattr(m, "BLOCK_DAYS", 9)
    r = np.random.default_rng(1)
    x = {"a": r.gamma(1, 50, 400), "b": np.concatenate([[1e6], np.zeros(95)]), "c": r.normal(0, 1, 9), "d": np.array([3.0])}
    rows = [(k, t, float(v), "kept") for k, v in x.items() for t, v in enumerate(v)]
    got = m.adstock_rows(spark.createDataFrame(rows, "key string, t long, x double, note string").repartition(3), decay).toPandas()
    assert list(got.columns) == ["key", "t", "x", "note", "stock"] and len(got) == len(rows)
    for k, v in x.items():
        mine = got[got["key"] == k].sort_values("t")["stock"].to_numpy()
        assert np.allclose(mine, m.adstock(v, decay), rtol=1e-9, atol=1e-9)


def test_adstock_of_many_days_is_linear(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("key"), F.col("id").alias("t"), (F.col("id") % 13).cast("double").alias("x"))
    last = m.adstock_rows(df, 0.9).where(F.col("t") == n - 1).first()["stock"]
    assert last == pytest.approx(m.adstock(np.arange(n) % 13.0, 0.9)[-1])
    with pytest.raises(ValueError):
        m.adstock_rows(df, 1.0)


def test_projected_candidates_equal_full_solves(spark):
    """The best candidate and its error, against a least-squares solve of every candidate; collinear fixed columns too."""
    r = np.random.default_rng(3)
    n = 200
    spend, dow = r.gamma(2, 30, (n, 3)), np.arange(n) % 7
    y = 100 + 5 * m.saturate(m.adstock(spend[:, 0], 0.4), 60.0) + 40 * m.saturate(m.adstock(spend[:, 1], 0.7), 90.0) + r.normal(0, 1, n)
    parts = [m.saturate(m.adstock(spend[:, 1], 0.2), 50.0), m.saturate(m.adstock(spend[:, 2], 0.1), 50.0)]
    for fixed in (m._design(parts, dow), m._design([*parts, parts[0]], dow)):
        got = m._best_response(spark, spend[:, 0], y, fixed)
        want = []
        for d in m.DECAYS:
            stock = m.adstock(spend[:, 0], d)
            for h in m.HALF_SATS:
                half = h * np.median(stock)
                want.append((m._sse(np.column_stack([fixed, m.saturate(stock, half)]), y), d, half))
        sse, d, half = min(want)
        assert got["decay"] == d and got["half"] == pytest.approx(half) and got["sse"] == pytest.approx(sse, rel=1e-9)
