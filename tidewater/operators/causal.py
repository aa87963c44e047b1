"""Causal estimators with assumption gates.

Each estimator has a diagnostics form (estimates and gate values, never refusing) and a raising form. Sums over rows are
Spark aggregates of moments; only k x k systems are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf, one_row, two_sided_p
from ..sources.settle import settle
from .experiments import TestResult, welch_from_moments


class AssumptionViolation(RuntimeError):
    """An identifying assumption fails its check; no estimate is given."""


@dataclass(frozen=True)
class OlsFit:
    beta: np.ndarray
    se: np.ndarray
    n: int
    sse: float


def ols(df: DataFrame, features: Sequence[str], y: str) -> OlsFit:
    """Least squares with intercept from one aggregate of centred cross-products after one of means."""
    k = len(features) + 1
    names = [*features, y]
    m = one_row(df, [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(names)], F.count_if(_bad(names)).alias("bad")])
    n = m["n"]
    if n <= k or m["bad"]:
        raise ValueError("more rows than coefficients are needed, all finite")
    mean = [m[f"m{j}"] for j in range(len(names))]
    d = [F.col(c) - F.lit(mean[j]) for j, c in enumerate(names)]
    s = one_row(df, [F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(i, len(names))])
    c = np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    slope = np.linalg.solve(xx, xy)
    beta = np.concatenate([[mean[-1] - slope @ np.array(mean[:-1])], slope])
    sse = float(yy - slope @ xy)
    inv = np.linalg.inv(xx)
    mu = np.array(mean[:-1])
    var = np.concatenate([[1 / n + mu @ inv @ mu], np.diag(inv)])
    return OlsFit(beta, np.sqrt(max(sse, 0) / (n - k) * var), n, sse)


def _bad(names: Sequence[str]) -> Column:
    test = F.lit(False)
    for c in names:
        v = F.col(c).cast("double")
        test = test | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return test


def linear_predictor(features: Sequence[str], beta: Sequence[float]) -> Column:
    z = F.lit(float(beta[0]))
    for c, b in zip(features, beta[1:]):
        z = z + F.lit(float(b)) * F.col(c)
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, ridge: float = 1e-6, max_iter: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Newton steps over the design columns, written once. The ridge includes the intercept."""
    return _newton(settle(df.select(*dict.fromkeys([*features, y]))), features, y, ridge, max_iter, tol)


def _newton(df: DataFrame, features: Sequence[str], y: str, ridge: float = 1e-6, max_iter: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Each step is one Spark aggregate of the gradient and Hessian."""
    names = list(features)
    k = len(names) + 1
    if df.where(F.col(y).isNull() | ~F.col(y).cast("double").isin(0.0, 1.0)).limit(1).count():
        raise ValueError("the outcome must be 0 or 1")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    beta = np.zeros(k)
    for _ in range(max_iter):
        p = sigmoid(linear_predictor(names, beta))
        rows = df.select(p.alias("_p"), F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{j}") for j, c in enumerate(x)])
        w = F.col("_p") * (1 - F.col("_p")) + F.lit(1e-12)
        s = one_row(rows, [*[F.sum(F.col(f"_x{i}") * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i in range(k)], *[F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]])
        g = np.array([s[f"g{i}"] for i in range(k)]) - ridge * beta
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < tol:
            return beta
    raise RuntimeError("the logistic fit does not converge")


def naive_difference(df: DataFrame, d: str, y: str) -> float:
    r = one_row(df, [F.avg(F.when(F.col(d).cast("int") == 1, F.col(y))).alias("t"), F.avg(F.when(F.col(d).cast("int") == 0, F.col(y))).alias("c")])
    return r["t"] - r["c"]


def naive_ols_slope(df: DataFrame, x: str, y: str) -> float:
    return one_row(df, [F.regr_slope(y, x).alias("b")])["b"]


# -- difference in differences -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class DidResult:
    att: float
    ci_low: float
    ci_high: float
    p_value: float
    placebo_p: float
    n_treated: int
    n_control: int


def unit_deltas(panel: DataFrame, unit: str, time: str, outcome: str, treated: str, late: Column, among: Column | None = None) -> DataFrame:
    """(unit, treated, delta): each unit's late mean less its early mean; units that lack either are dropped."""
    rows = panel if among is None else panel.where(among)
    means = rows.groupBy(unit).agg(F.min_by(treated, time).alias("treated"), F.avg(F.when(late, F.col(outcome))).alias("_a"), F.avg(F.when(~late, F.col(outcome))).alias("_b"))
    return means.where("_a IS NOT NULL AND _b IS NOT NULL").select(F.col(unit), F.col("treated").cast("int").alias("treated"), (F.col("_a") - F.col("_b")).alias("delta"))


def delta_moments(deltas: DataFrame) -> dict:
    c, t = F.when(F.col("treated") == 0, F.col("delta")), F.when(F.col("treated") == 1, F.col("delta"))
    return one_row(deltas, [F.count(c).alias("nc"), F.avg(c).alias("mc"), F.var_samp(c).alias("vc"), F.count(t).alias("nt"), F.avg(t).alias("mt"), F.var_samp(t).alias("vt")])


def did_diagnostics(panel: DataFrame, unit: str = "unit", time: str = "time", outcome: str = "y", treated: str = "treated", post: str = "post") -> tuple[TestResult, TestResult]:
    """(placebo over the halves of the period before, effect)."""
    if missing := {unit, time, outcome, treated, post} - set(panel.columns):
        raise ValueError(f"the panel lacks {sorted(missing)}")
    pre = ~F.col(post)
    mid = one_row(panel.where(pre), [F.percentile(F.col(time), F.lit(0.5)).alias("m")])["m"]
    if mid is None or panel.where(F.col(post)).limit(1).count() == 0:
        raise ValueError("the panel needs rows before and after")
    placebo = delta_moments(unit_deltas(panel, unit, time, outcome, treated, F.col(time) > F.lit(mid), pre))
    effect = delta_moments(unit_deltas(panel, unit, time, outcome, treated, F.col(post)))
    if effect["nc"] + effect["nt"] < 4:
        raise ValueError("four units at least are needed")
    return welch_from_moments(**placebo), welch_from_moments(**effect)


def diff_in_diff(panel: DataFrame, pretrend_alpha: float = 0.05, **columns) -> DidResult:
    placebo, effect = did_diagnostics(panel, **columns)
    if placebo.p_value < pretrend_alpha:
        raise AssumptionViolation(f"trends differ before the treatment (p = {placebo.p_value:.4g})")
    return DidResult(effect.estimate, effect.ci_low, effect.ci_high, effect.p_value, placebo.p_value, effect.n_treatment, effect.n_control)


# -- regression discontinuity ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RddResult:
    effect: float
    se: float
    bandwidth: float
    n_left: int
    n_right: int
    density_p: float


def rdd_diagnostics(df: DataFrame, running: str, outcome: str, cutoff: float, bandwidth: float | None = None) -> dict:
    """Counts next to the cutoff and local-linear fits of both sides, in two passes."""
    h = bandwidth or 0.5 * one_row(df, [F.stddev_pop(running).alias("s")])["s"]
    r = F.col(running) - F.lit(cutoff)
    bin_ = h / 5
    sides = {"l": (r >= -h) & (r < 0), "r": (r >= 0) & (r <= h)}
    cols = [F.count_if((r >= -bin_) & (r < 0)).alias("below"), F.count_if((r >= 0) & (r < bin_)).alias("above")]
    for k, inside in sides.items():
        x, y = F.when(inside, r), F.when(inside, F.col(outcome))
        cols += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mx{k}"), F.avg(y).alias(f"my{k}"), F.var_pop(x).alias(f"vx{k}"), F.var_pop(y).alias(f"vy{k}"), F.covar_pop(y, x).alias(f"c{k}")]
    m = one_row(df, cols) | {"h": h}
    for k in sides:
        n = m[f"n{k}"]
        if n > 2 and m[f"vx{k}"]:
            b = m[f"c{k}"] / m[f"vx{k}"]
            m[f"a{k}"] = m[f"my{k}"] - b * m[f"mx{k}"]
            s2 = n * (m[f"vy{k}"] - b * m[f"c{k}"]) / (n - 2)
            m[f"va{k}"] = s2 * (1 / n + m[f"mx{k}"] ** 2 / (n * m[f"vx{k}"]))
    return m


def sharp_rdd(df: DataFrame, running: str, outcome: str, cutoff: float, bandwidth: float | None = None, density_alpha: float = 0.001) -> RddResult:
    m = rdd_diagnostics(df, running, outcome, cutoff, bandwidth)
    near = m["above"] + m["below"]
    if near < 20:
        raise ValueError("under 20 rows next to the cutoff")
    p = two_sided_p((m["above"] - m["below"]) / math.sqrt(near))
    if p < density_alpha:
        raise AssumptionViolation(f"the running variable bunches at the cutoff (p = {p:.4g})")
    if min(m["nl"], m["nr"]) < 10:
        raise ValueError("under 10 rows on a side")
    return RddResult(m["ar"] - m["al"], math.sqrt(m["val"] + m["var"]), m["h"], m["nl"], m["nr"], p)


# -- inverse propensity weighting --------------------------------------------------------------------------------


@dataclass(frozen=True)
class IpwResult:
    ate: float
    se: float
    propensity_min: float
    propensity_max: float
    max_smd: float


def ipw_diagnostics(df: DataFrame, features: Sequence[str], d: str, y: str, overlap_eps: float = 0.02) -> dict:
    """Propensity fit, then Hajek means, overlap and weighted balance in one wide aggregate and the error in another."""
    df = settle(df.select(*dict.fromkeys([*features, d, y])))
    beta = _newton(df, features, d)
    e = sigmoid(linear_predictor(list(features), beta))
    rows = df.select(e.alias("e"), F.col(d).cast("double").alias("d"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    rows = rows.withColumn("wt", F.col("d") / F.col("e")).withColumn("wc", (1 - F.col("d")) / (1 - F.col("e")))
    k = len(features)
    cols = [F.sum("wt").alias("swt"), F.sum("wc").alias("swc"), F.sum(F.col("wt") * F.col("y")).alias("yt"), F.sum(F.col("wc") * F.col("y")).alias("yc"), F.min("e").alias("emin"), F.max("e").alias("emax"), F.avg(((F.col("e") < overlap_eps) | (F.col("e") > 1 - overlap_eps)).cast("double")).alias("extreme")]
    for j in range(k):
        cols += [F.sum(F.col("wt") * F.col(f"x{j}")).alias(f"t{j}"), F.sum(F.col("wc") * F.col(f"x{j}")).alias(f"c{j}"), F.stddev_pop(f"x{j}").alias(f"s{j}")]
    m = one_row(rows, cols)
    mt, mc = m["yt"] / m["swt"], m["yc"] / m["swc"]
    smd = [abs(m[f"t{j}"] / m["swt"] - m[f"c{j}"] / m["swc"]) / m[f"s{j}"] if m[f"s{j}"] else 0.0 for j in range(k)]
    v = one_row(rows, [F.sum(F.pow(F.col("wt") * (F.col("y") - F.lit(mt)), 2)).alias("t"), F.sum(F.pow(F.col("wc") * (F.col("y") - F.lit(mc)), 2)).alias("c")])
    return {"ate": mt - mc, "se": math.sqrt(v["t"] / m["swt"] ** 2 + v["c"] / m["swc"] ** 2), "emin": m["emin"], "emax": m["emax"], "extreme": m["extreme"], "max_smd": max(smd, default=0.0), "beta": beta}


def ipw_ate(df: DataFrame, features: Sequence[str], d: str, y: str, overlap_eps: float = 0.02, max_extreme_share: float = 0.02, balance_threshold: float = 0.10) -> IpwResult:
    m = ipw_diagnostics(df, features, d, y, overlap_eps)
    if m["extreme"] > max_extreme_share:
        raise AssumptionViolation(f"{m['extreme']:.1%} of the rows lack overlap")
    if m["max_smd"] > balance_threshold:
        raise AssumptionViolation(f"weighting leaves a mean difference of {m['max_smd']:.3f} deviations")
    return IpwResult(m["ate"], m["se"], m["emin"], m["emax"], m["max_smd"])


# -- instruments -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class IvResult:
    estimate: float
    se: float
    first_stage_f: float
    n: int


def iv_diagnostics(df: DataFrame, z: str, x: str, y: str) -> IvResult:
    """Everything from one aggregate of means, variances and covariances."""
    m = one_row(df, [F.count(F.lit(1)).alias("n"), F.var_pop(z).alias("vz"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(z, x).alias("zx"), F.covar_pop(z, y).alias("zy"), F.covar_pop(x, y).alias("xy")])
    n = m["n"]
    if n < 3 or not m["vz"] or not m["zx"]:
        raise ValueError("the instrument does not vary with the exposure")
    first = m["zx"] / m["vz"]
    left = n * (m["vx"] - first * m["zx"]) / (n - 2)
    f = first**2 * n * m["vz"] / left if left > 0 else math.inf
    b = m["zy"] / m["zx"]
    s2 = n * (m["vy"] - 2 * b * m["xy"] + b * b * m["vx"]) / (n - 2)
    return IvResult(b, math.sqrt(s2 * m["vz"] / (n * m["zx"] ** 2)), f, n)


def two_stage_least_squares(df: DataFrame, z: str, x: str, y: str, f_threshold: float = 10.0) -> IvResult:
    r = iv_diagnostics(df, z, x, y)
    if r.first_stage_f < f_threshold:
        raise AssumptionViolation(f"weak instrument: F = {r.first_stage_f:.2f}")
    return r


# -- uplift ------------------------------------------------------------------------------------------------------


def t_learner(df: DataFrame, features: Sequence[str], d: str, y: str, out: str = "cate") -> DataFrame:
    """Every row with the difference of two logistic fits, one for each arm."""
    rows = settle(df.select(*dict.fromkeys([*features, d, y])))
    n = one_row(rows, [F.count_if(F.col(d).cast("int") == 1).alias("t"), F.count_if(F.col(d).cast("int") == 0).alias("c")])
    if min(n["t"], n["c"]) < 30:
        raise ValueError("under 30 rows in an arm")
    fits = [_newton(rows.where(F.col(d).cast("int") == arm), features, y) for arm in (1, 0)]
    p1, p0 = (sigmoid(linear_predictor(list(features), b)) for b in fits)
    return df.withColumn(out, p1 - p0)


def segment_effect(scored: DataFrame, mask: Column, cate: str = "cate") -> float:
    return one_row(scored.where(mask), [F.avg(cate).alias("m")])["m"]


def ci(estimate: float, se: float, alpha: float = 0.05) -> tuple[float, float]:
    half = norm_ppf(1 - alpha / 2) * se
    return estimate - half, estimate + half
