"""Forecasting: seasonal naive, Holt-Winters, boosted stumps, rolling-origin backtests, bottom-up totals.

A series is ordered by position t and has season 7. Recursion is inherently sequential inside one series, so series,
folds and grid points are what tasks share out. A model that can be fitted to every prefix of a series in one scan
(``fit_prefixes``) shares the scan between the folds of a backtest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON = 7


class Forecaster(Protocol):
    def fit(self, y: np.ndarray) -> Forecaster: ...

    def predict(self, horizon: int) -> np.ndarray: ...


def fit_prefixes(make: Callable[[], Forecaster], y: np.ndarray, ends: Sequence[int]) -> dict[int, Forecaster | None]:
    """A model fitted to y[:end] for each end, None where that is too short: in one scan if the model has one."""
    scan = getattr(make(), "fit_prefixes", None)
    if scan is not None:
        return scan(y, ends)
    out: dict[int, Forecaster | None] = {}
    for end in ends:
        try:
            out[end] = make().fit(y[:end])
        except ValueError:
            out[end] = None
    return out


class SeasonalNaive:
    """The last season again and again."""

    def fit_prefixes(self, y, ends):
        return {e: SeasonalNaive().fit(y[e - SEASON : e]) if e >= SEASON else None for e in ends}

    def fit(self, y):
        if len(y) < SEASON:
            raise ValueError("one season at least is needed")
        self.last = np.asarray(y, float)[-SEASON:]
        return self

    def predict(self, horizon):
        return self.last[np.arange(horizon) % SEASON]


ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7), (0.01, 0.05, 0.1), (0.05, 0.1, 0.3)


class HoltWinters:
    """Additive level, trend and season; the best of 36 parameter triples by squared error from the third season on."""

    def fit(self, y):
        y = np.asarray(y, float)
        if len(y) < 3 * SEASON:
            raise ValueError("three seasons at least are needed")
        best = None
        for a in ALPHAS:
            for b in BETAS:
                for g in GAMMAS:
                    got = self._run(y, a, b, g)
                    if best is None or got[0] < best[0]:
                        best = (*got, (a, b, g))
        self.sse, self.level, self.trend, self.season, self.params = best
        self.n = len(y)
        return self

    def fit_prefixes(self, y, ends):
        """The recurrence runs once, for all parameter triples side by side, and its state is kept at each end."""
        y = np.asarray(y, float)
        out = dict.fromkeys(ends)
        ends = {e for e in ends if e >= 3 * SEASON}
        if not ends:
            return out
        grid = [(a, b, g) for a in ALPHAS for b in BETAS for g in GAMMAS]
        a, b, g = np.array(grid).T
        level = np.full(len(grid), y[:SEASON].mean())
        trend = (y[SEASON : 2 * SEASON].mean() - level) / SEASON
        season, sse = [v - level for v in y[:SEASON]], np.zeros(len(grid))
        for t, v in enumerate(y[: max(ends)].tolist()):
            s = season[t % SEASON]
            if t >= 2 * SEASON:
                sse += (v - level - trend - s) ** 2
            new = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % SEASON] = g * (v - new) + (1 - g) * s
            level = new
            if t + 1 in ends:
                k = int(np.argmin(sse))
                m = out[t + 1] = HoltWinters()
                m.sse, m.level, m.trend, m.season, m.params, m.n = float(sse[k]), float(level[k]), float(trend[k]), [float(x[k]) for x in season], grid[k], t + 1
        return out

    @staticmethod
    def _run(y, a, b, g):
        level, trend = y[:SEASON].mean(), (y[SEASON : 2 * SEASON].mean() - y[:SEASON].mean()) / SEASON
        season, sse = list(y[:SEASON] - level), 0.0
        for t, v in enumerate(y.tolist()):
            s = season[t % SEASON]
            if t >= 2 * SEASON:
                sse += (v - level - trend - s) ** 2
            new = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % SEASON] = g * (v - new) + (1 - g) * s
            level = new
        return sse, level, trend, season

    def predict(self, horizon):
        return np.array([self.level + (h + 1) * self.trend + self.season[(self.n + h) % SEASON] for h in range(horizon)])


class BoostedStumps:
    """Gradient boosting of one-split trees on lags 1, 7 and 14, weekday and time; forecasts feed back into the lags."""

    def __init__(self, rounds: int = 300, rate: float = 0.1):
        self.rounds, self.rate = rounds, rate

    @staticmethod
    def _features(y, at):
        at = np.asarray(at)
        return np.column_stack([y[at - 1], y[at - 7], y[at - 14], *[(at % SEASON == k).astype(float) for k in range(1, SEASON)], at])

    def fit(self, y):
        y = np.asarray(y, float)
        if len(y) < 4 * SEASON:
            raise ValueError("four seasons at least are needed")
        at = np.arange(14, len(y))
        x, target = self._features(y, at), y[at]
        self.base, self.stumps, self.y = target.mean(), [], y
        cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9)))]
        masks = np.array([x[:, f] <= c for f, c in cuts], float)
        n_low = masks.sum(axis=1)
        usable = (n_low > 0) & (n_low < len(at))
        masks, n_low, cuts = masks[usable], n_low[usable], [c for c, u in zip(cuts, usable) if u]
        r = target - self.base
        for _ in range(self.rounds):
            low = masks @ r
            high = r.sum() - low
            k = int(np.argmax(low**2 / n_low + high**2 / (len(r) - n_low)))
            a, b = low[k] / n_low[k], high[k] / (len(r) - n_low[k])
            r = r - self.rate * np.where(masks[k] > 0, a, b)
            self.stumps.append((*cuts[k], a, b))
        return self

    def predict(self, horizon):
        y = self.y.tolist()
        for _ in range(horizon):
            x = self._features(np.array(y[-14:] + [0.0]), [14])[0]
            t = len(y)
            x[3:9], x[9] = [float(t % SEASON == k) for k in range(1, SEASON)], t
            y.append(self.base + self.rate * sum(a if x[f] <= c else b for f, c, a, b in self.stumps))
        return np.array(y[len(self.y) :])


MODELS: dict[str, Callable[[], Forecaster]] = {"seasonal_naive": SeasonalNaive, "holt_winters": HoltWinters, "boosted_stumps": BoostedStumps}


def forecast(series: DataFrame, model: str | Callable[[], Forecaster], horizon: int) -> DataFrame:
    """(key, t, y) -> (key, h, forecast), one task for each series."""
    make = MODELS[model] if isinstance(model, str) else model

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        p = make().fit(pdf["y"].to_numpy(float)).predict(horizon)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "h": np.arange(1, horizon + 1), "forecast": p})

    return series.groupBy("key").applyInPandas(run, "key string, h long, forecast double")


def seasonal_naive_native(series: DataFrame, horizon: int) -> DataFrame:
    """The same forecast without Python: the last season joined to the horizon by position."""
    last = series.groupBy("key").agg(F.max("t").alias("_last"))
    tail = series.join(last, "key").where(F.col("t") > F.col("_last") - SEASON).withColumn("_r", (F.col("t") - F.col("_last") + SEASON - 1).cast("int"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    out = tail.select("key", "_r", "y", steps).where((F.col("h") - 1) % SEASON == F.col("_r"))
    return out.select("key", F.col("h").cast("long").alias("h"), F.col("y").alias("forecast"))


def holt_winters_grid(series: DataFrame) -> DataFrame:
    """(key, alpha, beta, gamma, sse) for all grid points, which fan out as rows of their own."""
    grid = series.sparkSession.createDataFrame([(a, b, g) for a in ALPHAS for b in BETAS for g in GAMMAS], "alpha double, beta double, gamma double")
    packed = series.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"))  # one series in one row
    rows = packed.select("key", F.transform("s", lambda x: x["y"]).alias("y")).join(F.broadcast(grid))  # 36 rows

    def run(batches):
        for pdf in batches:
            sse = [HoltWinters._run(np.asarray(y, float), a, b, g)[0] for y, a, b, g in zip(pdf["y"], pdf["alpha"], pdf["beta"], pdf["gamma"])]
            yield pdf[["key", "alpha", "beta", "gamma"]].assign(sse=sse)

    return rows.mapInPandas(run, "key string, alpha double, beta double, gamma double, sse double")


@dataclass(frozen=True)
class BacktestResult:
    n_folds: int
    horizon: int
    mae: float
    rmse: float
    mase: float
    pinball: dict[float, float]

    @property
    def beats_baseline(self) -> bool:
        return self.mase < 1


QUANTILES = (0.1, 0.5, 0.9)


def holdout(n: int) -> int:
    """Days at the end of n that the error quantiles are taken from."""
    return min(n // 5, 28)


def quantile_forecasts(inner: Forecaster | None, y: np.ndarray, point: np.ndarray) -> dict[float, np.ndarray]:
    """Tails are the point forecast shifted by error quantiles of a model of the data before the holdout (None: too little for one)."""
    errors = y[-holdout(len(y)) :] - inner.predict(holdout(len(y))) if inner is not None else np.zeros(1)
    return {q: point if q == 0.5 else point + np.quantile(errors, q) for q in QUANTILES}


def backtest_rows(series: DataFrame, model: str | Callable[[], Forecaster], first_origin: int, horizon: int = 14, step: int = 28) -> DataFrame:
    """(key, origin, h, y, forecast, naive, q10, q50, q90): each fold sees its past only.

    A model with a scan of its own is fitted to all origins of a series at once, so the cost is that of one pass over its days. For
    any other model a fold is a row of work of its own."""
    make = MODELS[model] if isinstance(model, str) else model
    out = "key string, origin long, h long, y double, forecast double, naive double, q10 double, q50 double, q90 double"

    def rows(key, y: np.ndarray, origins: Sequence[int]) -> pd.DataFrame:
        fitted = fit_prefixes(make, y, sorted({e for o in origins for e in (o, o - holdout(o))}))
        naive, found = fit_prefixes(SeasonalNaive, y, origins), []
        for o in origins:
            point = (fitted[o] or make().fit(y[:o])).predict(horizon)
            q = quantile_forecasts(fitted[o - holdout(o)], y[:o], point)
            found.append({"origin": np.full(horizon, o), "h": np.arange(1, horizon + 1), "y": y[o : o + horizon], "forecast": point, "naive": (naive[o] or SeasonalNaive().fit(y[:o])).predict(horizon), "q10": q[0.1], "q50": q[0.5], "q90": q[0.9]})
        names = [c.split()[0] for c in out.split(", ")][1:]
        return pd.DataFrame({"key": pd.Series([key] * (horizon * len(found)), dtype=object), **{c: np.concatenate([np.zeros(0), *(x[c] for x in found)]) for c in names}})

    if hasattr(make(), "fit_prefixes"):

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.sort_values("t")["y"].to_numpy(float)
            return rows(pdf["key"].iloc[0], y, range(first_origin, len(y) - horizon + 1, step))

        return series.select("key", "t", "y").groupBy("key").applyInPandas(scan, out)
    packed = series.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"), F.count(F.lit(1)).alias("n"))
    folds = packed.where(F.col("n") >= first_origin + horizon).select("key", F.transform("s", lambda x: x["y"]).alias("y"), F.explode(F.sequence(F.lit(first_origin), (F.col("n") - horizon).cast("int"), F.lit(step))).alias("origin"))
    folds = folds.repartition(F.col("key"), F.col("origin")).select("key", F.slice("y", 1, F.col("origin") + horizon).alias("y"), "origin")

    def run(batches):
        for pdf in batches:
            for key, y, o in zip(pdf["key"], pdf["y"], pdf["origin"]):
                yield rows(key, np.asarray(y, float), [o])

    return folds.mapInPandas(run, out)


def backtest_metrics(rows: DataFrame) -> DataFrame:
    """key, n_folds, mae, rmse, mase, pinball losses."""
    e, n = F.abs(F.col("y") - F.col("forecast")), F.abs(F.col("y") - F.col("naive"))

    def pinball(c: str, q: float):
        d = F.col("y") - F.col(c)
        return F.avg(F.greatest(F.lit(q) * d, F.lit(q - 1) * d)).alias(f"pinball_{int(q * 100)}")

    return rows.groupBy("key").agg(
        F.countDistinct("origin").alias("n_folds"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(e) / F.nullif(F.avg(n), F.lit(0.0))).alias("mase"), pinball("q10", 0.1), pinball("q50", 0.5), pinball("q90", 0.9)
    )


def rolling_origin_backtest(spark: SparkSession, y: np.ndarray, model, first_origin: int, horizon: int = 14, step: int = 28) -> BacktestResult:
    df = spark.createDataFrame(pd.DataFrame({"key": "y", "t": np.arange(len(y)), "y": np.asarray(y, float)}))
    r = backtest_metrics(backtest_rows(df, model, first_origin, horizon, step)).first()
    if r is None:
        raise ValueError("the series is too short for a fold")
    if r["mase"] is None:
        raise RuntimeError("the naive forecast has no error to compare with")
    return BacktestResult(r["n_folds"], horizon, r["mae"], r["rmse"], r["mase"], {q: r[f"pinball_{int(q * 100)}"] for q in QUANTILES})


def bottom_up_forecast(series: DataFrame, model, horizon: int) -> DataFrame:
    """(key, h, forecast) of the children and, under the key 'total', of their sum: coherent by construction."""
    children = forecast(series, model, horizon)
    total = children.groupBy("h").agg(F.sum("forecast").alias("forecast")).select(F.lit("total").alias("key"), "h", "forecast")
    return children.unionByName(total)
