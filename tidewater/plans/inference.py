"""Queries of experiments and causal estimators: estimates and diagnostics, rounded."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.stats import assign_arm, norm_cdf_column
from ..operators import causal as c
from ..operators import experiments as x
from ..sources import adapters as a
from ..sources.adapters import Tables, with_views

EXPERIMENT = "checkout-test"


def one(spark, digits: int = 6, **values):
    """A one-row DataFrame of scalars."""
    out = {}
    for k, v in values.items():
        if isinstance(v, bool):
            out[k] = v
        elif isinstance(v, float):
            out[k] = None if math.isnan(v) else round(v, digits)
        else:
            out[k] = v
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in out.items()))


def arms(t: Tables):
    """unit, arm, converted, x (balance before), y."""
    rows = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    return rows.select(F.col("c_custkey").alias("unit"), assign_arm(EXPERIMENT, F.col("c_custkey")).alias("arm"), (F.col("c_acctbal") >= 0).alias("converted"), (F.col("c_nationkey") < 20).alias("kept"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * 0.5 + F.col("c_nationkey") * 10).alias("y"))


ARMS = f"""arms AS (SELECT c_custkey AS unit, CAST(('0x' || substr(sha256('{EXPERIMENT}:' || c_custkey), 1, 16))::UBIGINT % 2 AS INTEGER) AS arm,
    c_acctbal >= 0 AS converted, c_nationkey < 20 AS kept, c_acctbal AS x, c_acctbal * 0.5 + c_nationkey * 10 AS y FROM customer),
    m AS (SELECT count(*) FILTER (arm = 0)::DOUBLE AS nc, count(*) FILTER (arm = 1)::DOUBLE AS nt, count(*) FILTER (arm = 0 AND converted)::DOUBLE AS xc, count(*) FILTER (arm = 1 AND converted)::DOUBLE AS xt,
      count(*) FILTER (arm = 0 AND kept)::DOUBLE AS kc, count(*) FILTER (arm = 1 AND kept)::DOUBLE AS kt FROM arms)"""
Z975, Z95, Z80 = "1.959963984540054", "1.6448536269514722", "0.8416212335729143"


def two_prop(spark, d):
    ctl, trt = x.arm_counts(arms(Tables(spark, d)), "arm", "converted")
    r = x.two_proportion_ztest(ctl.conversions, ctl.n, trt.conversions, trt.n)
    return one(spark, estimate=r.estimate, ci_low=r.ci_low, ci_high=r.ci_high, z=r.z, n_control=r.n_control, n_treatment=r.n_treatment)


def srm(spark, d):
    ctl, trt = x.arm_counts(arms(Tables(spark, d)), "arm", "converted")
    r = x.srm_check(ctl.n, trt.n)
    return one(spark, n_control=r.n_control, n_treatment=r.n_treatment, z=r.z, passed=r.passed)


def welch(spark, d):
    r = x.welch_test(arms(Tables(spark, d)), "arm", "y")
    return one(spark, estimate=r.estimate, ci_low=r.ci_low, ci_high=r.ci_high, z=r.z, n_control=r.n_control, n_treatment=r.n_treatment)


def cuped(spark, d):
    rows = arms(Tables(spark, d))
    theta = x.cuped_theta(rows, "y", "x")
    r = x.welch_test(x.cuped_adjust(rows, "y", "x", theta), "arm", "y_cuped")
    return one(spark, theta=theta, estimate=r.estimate, z=r.z)


def noninferiority(spark, d):
    ctl, trt = x.arm_counts(arms(Tables(spark, d)), "arm", "converted", ["kept"])
    r = x.non_inferiority_test(x.GuardrailSpec("kept", 0.05), ctl.guardrails["kept"], ctl.n, trt.guardrails["kept"], trt.n)
    return one(spark, control_rate=r.control_rate, treatment_rate=r.treatment_rate, z=r.z)


def readout(spark, d):
    ctl, trt = x.arm_counts(arms(Tables(spark, d)), "arm", "converted", ["kept"])
    r = x.evaluate(x.ExperimentDesign(EXPERIMENT, 0.9, 0.05, guardrails=(x.GuardrailSpec("kept", 0.05),)), ctl, trt)
    return one(spark, decision=r.decision.value, srm_passed=r.srm.passed, estimate=r.primary.estimate if r.primary else float("nan"))


def power(spark, d):
    rows = spark.createDataFrame([(b, m) for b in (0.05, 0.1, 0.2) for m in (0.05, 0.1, 0.2)], "baseline double, mde double").collect()
    return spark.createDataFrame([(r.baseline, r.mde, x.required_n_per_arm(r.baseline, r.mde), round(x.minimum_detectable_effect(20_000, r.baseline), 6)) for r in rows], "baseline double, mde double, n_per_arm long, mde_20k double")


def sequential(spark, d):
    design = x.SequentialDesign.create(5)
    looks = Tables(spark, d).events.groupBy("event_type", (F.col("event_id") % 5 + 1).cast("int").alias("look")).agg(F.avg("value").alias("m"))
    looks = looks.select("event_type", "look", ((F.col("m") - 50) / 10).alias("z"))
    return x.first_crossing(looks, design.boundaries, "event_type")


def p_values(spark, d):
    z = Tables(spark, d).events.select("event_id", ((F.col("value") - 50) / 50).alias("z"))
    return z.select("event_id", F.round(norm_cdf_column("z"), 9).alias("phi"))


def did(spark, d):
    placebo, effect = c.did_diagnostics(a.panel(Tables(spark, d)))
    return one(spark, 4, att=effect.estimate, ci_low=effect.ci_low, ci_high=effect.ci_high, z=effect.z, placebo_z=placebo.z, n_treated=effect.n_treatment, n_control=effect.n_control)


def rdd(spark, d):
    m = c.rdd_diagnostics(a.rdd_rows(Tables(spark, d)), "running", "outcome", 4000.0)
    return one(spark, 2, effect=m["ar"] - m["al"], se=math.sqrt(m["val"] + m["var"]), bandwidth=m["h"], n_left=m["nl"], n_right=m["nr"], below=m["below"], above=m["above"])


def iv(spark, d):
    r = c.iv_diagnostics(a.iv_rows(Tables(spark, d)), "z", "x", "y")
    return one(spark, estimate=r.estimate, se=r.se, first_stage_f=round(r.first_stage_f, 3), n=r.n)


def ipw(spark, d):
    m = c.ipw_diagnostics(a.ipw_rows(Tables(spark, d)), ["x"], "d", "y")
    return one(spark, 4, ate=m["ate"], se=m["se"], e_min=m["emin"], e_max=m["emax"], max_smd=abs(m["max_smd"]))


def t_learner(spark, d):
    rows = a.ipw_rows(Tables(spark, d)).withColumn("d", F.col("d").cast("int"))
    scored = c.t_learner(rows, ["x"], "d", "y")
    return scored.groupBy("x").agg(F.round(F.avg("cate"), 4).alias("cate"), F.count(F.lit(1)).alias("n"))


def ols_fit(spark, d):
    r = c.ols(a.iv_rows(Tables(spark, d)), ["z", "x"], "y")
    return one(spark, 4, b1=float(r.beta[1]), b2=float(r.beta[2]), n=r.n)


QUERIES = {
    "assign_arm": lambda s, d: arms(Tables(s, d)).select("unit", "arm"),
    "srm": srm,
    "two_prop": two_prop,
    "welch": welch,
    "cuped": cuped,
    "noninferiority": noninferiority,
    "experiment_readout": readout,
    "power_analysis": power,
    "sequential_crossing": sequential,
    "normal_cdf": p_values,
    "did": did,
    "rdd": rdd,
    "iv_2sls": iv,
    "ipw": ipw,
    "t_learner": t_learner,
    "ols_fit": ols_fit,
    "naive_diff": lambda s, d: one(s, naive=c.naive_difference(a.ipw_rows(Tables(s, d)), "d", "y")),
    "ols_slope": lambda s, d: one(s, slope=c.naive_ols_slope(a.iv_rows(Tables(s, d)), "x", "y")),
}

_W = """(mt - mc) / sqrt(vc / nc + vt / nt)"""
_UNITS = f"""ceil(({Z975} * sqrt(2 * ({{b}} + {{o}}) / 2 * (1 - ({{b}} + {{o}}) / 2)) + {Z80} * sqrt({{b}} * (1 - {{b}}) + {{o}} * (1 - {{o}}))) ** 2 / ({{o}} - {{b}}) ** 2)"""
_SIDE = """count(*) FILTER (WHERE {w})::DOUBLE AS n{k}, avg(r) FILTER (WHERE {w}) AS mx{k}, avg(y) FILTER (WHERE {w}) AS my{k}, var_pop(r) FILTER (WHERE {w}) AS vx{k}, var_pop(y) FILTER (WHERE {w}) AS vy{k}, covar_pop(y, r) FILTER (WHERE {w}) AS c{k}"""
ORACLE = {
    "assign_arm": f"WITH {ARMS} SELECT unit, arm FROM arms",
    "experiment_readout": f"""WITH {ARMS}, q AS (SELECT *, xt / nt - xc / nc AS e, (xc + xt) / (nc + nt) AS p, abs((nt - (nc + nt) * 0.5) / sqrt((nc + nt) * 0.25)) <= 3.2905267314919255 AS srm,
          (kt / nt - kc / nc + 0.05) / sqrt(kc / nc * (1 - kc / nc) / nc + kt / nt * (1 - kt / nt) / nt) > {Z95} AS clear,
          ceil(({Z975} * sqrt(2 * 0.9225 * 0.0775) + {Z80} * sqrt(0.9 * 0.1 + 0.945 * 0.055)) ** 2 / 0.045 ** 2) AS planned FROM m),
        s AS (SELECT *, abs(e / sqrt(p * (1 - p) * (1 / nc + 1 / nt))) > {Z975} AS sig FROM q)
        SELECT CASE WHEN NOT srm THEN 'invalid' WHEN sig AND e < 0 THEN 'no_launch' WHEN sig AND clear THEN 'launch' WHEN least(nc, nt) < planned THEN 'continue' ELSE 'no_launch' END AS decision, srm AS srm_passed, CASE WHEN srm THEN round(e, 6) END AS estimate FROM s""",
    "power_analysis": f"""WITH RECURSIVE g AS (SELECT b::DOUBLE AS b, m::DOUBLE AS m FROM (VALUES (0.05), (0.1), (0.2)) x(b), (VALUES (0.05), (0.1), (0.2)) y(m)),
        r(k, b, low, high) AS (SELECT 0, b, 1e-9::DOUBLE, (1 - 1e-9) / b - 1 FROM (SELECT DISTINCT b FROM g)
          UNION ALL SELECT k + 1, b, CASE WHEN {_UNITS.format(o='o', b='b')} > 20000 THEN mid ELSE low END, CASE WHEN {_UNITS.format(o='o', b='b')} > 20000 THEN high ELSE mid END
          FROM (SELECT k, b, low, high, (low + high) / 2 AS mid, b * (1 + (low + high) / 2) AS o FROM r WHERE k < 100))
        SELECT g.b AS baseline, m AS mde, {_UNITS.format(o='(g.b * (1 + m))', b='g.b')}::BIGINT AS n_per_arm, round(high, 6) AS mde_20k FROM g JOIN r ON g.b = r.b AND k = 100""",
    # the published boundaries of five looks at 0.05
    "sequential_crossing": """WITH l AS (SELECT event_type, event_id % 5 + 1 AS look, (avg(value) - 50) / 10 AS z FROM events GROUP BY 1, 2)
        SELECT event_type, (min(look) FILTER (WHERE abs(z) > [4.877, 3.357, 2.680, 2.290, 2.031][look]))::INTEGER AS first_look FROM l GROUP BY 1""",
    # a series of positive terms: density * sum of z^(2k+1) / (1 * 3 * ... * (2k+1))
    "normal_cdf": """WITH z AS (SELECT event_id, (value - 50) / 50 AS z FROM events),
        t AS (SELECT event_id, z, list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-30)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1) - z * z / 2))) / sqrt(2 * pi()) AS half FROM z)
        SELECT event_id, round(CASE WHEN z > 9 THEN 1.0 WHEN z < -9 THEN 0.0 ELSE 0.5 + sign(z) * half END, 9) AS phi FROM t""",
    "srm": f"WITH {ARMS} SELECT nc::BIGINT AS n_control, nt::BIGINT AS n_treatment, round((nt - (nc + nt) * 0.5) / sqrt((nc + nt) * 0.25), 6) AS z, abs((nt - (nc + nt) * 0.5) / sqrt((nc + nt) * 0.25)) <= 3.2905267314919255 AS passed FROM m",
    "two_prop": f"""WITH {ARMS}, q AS (SELECT *, xt / nt - xc / nc AS e, (xc + xt) / (nc + nt) AS p, {Z975} * sqrt(xc / nc * (1 - xc / nc) / nc + xt / nt * (1 - xt / nt) / nt) AS h FROM m)
        SELECT round(e, 6) AS estimate, round(e - h, 6) AS ci_low, round(e + h, 6) AS ci_high, round(e / sqrt(p * (1 - p) * (1 / nc + 1 / nt)), 6) AS z, nc::BIGINT AS n_control, nt::BIGINT AS n_treatment FROM q""",
    "welch": f"""WITH {ARMS}, w AS (SELECT avg(y) FILTER (arm = 0) AS mc, avg(y) FILTER (arm = 1) AS mt, var_samp(y) FILTER (arm = 0) AS vc, var_samp(y) FILTER (arm = 1) AS vt FROM arms)
        SELECT round(mt - mc, 6) AS estimate, round(mt - mc - {Z975} * sqrt(vc / nc + vt / nt), 6) AS ci_low, round(mt - mc + {Z975} * sqrt(vc / nc + vt / nt), 6) AS ci_high, round({_W}, 6) AS z, nc::BIGINT AS n_control, nt::BIGINT AS n_treatment FROM m, w""",
    "cuped": f"""WITH {ARMS}, th AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS mx FROM arms), adj AS (SELECT arm, y - theta * (x - mx) AS y FROM arms, th),
        w AS (SELECT avg(y) FILTER (arm = 0) AS mc, avg(y) FILTER (arm = 1) AS mt, var_samp(y) FILTER (arm = 0) AS vc, var_samp(y) FILTER (arm = 1) AS vt FROM adj)
        SELECT round(theta, 6) AS theta, round(mt - mc, 6) AS estimate, round({_W}, 6) AS z FROM m, w, th""",
    "noninferiority": f"WITH {ARMS} SELECT round(kc / nc, 6) AS control_rate, round(kt / nt, 6) AS treatment_rate, round((kt / nt - kc / nc + 0.05) / sqrt(kc / nc * (1 - kc / nc) / nc + kt / nt * (1 - kt / nt) / nt), 6) AS z FROM m",
    "did": with_views(
        f"""WITH med AS (SELECT quantile_cont(time, 0.5) AS t FROM panel WHERE NOT post),
        u AS (SELECT unit, arg_min(treated, time) AS treated, avg(y) FILTER (WHERE post) - avg(y) FILTER (WHERE NOT post) AS delta FROM panel GROUP BY unit),
        p AS (SELECT unit, arg_min(treated, time) AS treated, avg(y) FILTER (WHERE time > t) - avg(y) FILTER (WHERE time <= t) AS delta FROM panel, med WHERE NOT post GROUP BY unit),
        wu AS (SELECT count(delta) FILTER (NOT treated) AS nc, count(delta) FILTER (treated) AS nt, avg(delta) FILTER (NOT treated) AS mc, avg(delta) FILTER (treated) AS mt, var_samp(delta) FILTER (NOT treated) AS vc, var_samp(delta) FILTER (treated) AS vt FROM u),
        wp AS (SELECT count(delta) FILTER (NOT treated) AS nc, count(delta) FILTER (treated) AS nt, avg(delta) FILTER (NOT treated) AS mc, avg(delta) FILTER (treated) AS mt, var_samp(delta) FILTER (NOT treated) AS vc, var_samp(delta) FILTER (treated) AS vt FROM p)
        SELECT round(mt - mc, 4) AS att, round(mt - mc - {Z975} * sqrt(vc / nc + vt / nt), 4) AS ci_low, round(mt - mc + {Z975} * sqrt(vc / nc + vt / nt), 4) AS ci_high, round({_W}, 4) AS z,
        (SELECT round({_W}, 4) FROM wp) AS placebo_z, nt AS n_treated, nc AS n_control FROM wu""",
        "panel",
    ),
    "rdd": with_views(
        f"""WITH b AS (SELECT 0.5 * stddev_pop(running) AS h FROM rdd_rows), s AS (SELECT running - 4000.0 AS r, outcome AS y, h FROM rdd_rows, b),
        q AS (SELECT any_value(h) AS h, count(*) FILTER (WHERE r >= -h / 5 AND r < 0) AS below, count(*) FILTER (WHERE r >= 0 AND r < h / 5) AS above, {_SIDE.format(k='l', w='r >= -h AND r < 0')}, {_SIDE.format(k='r', w='r >= 0 AND r <= h')} FROM s)
        SELECT round((myr - cr / vxr * mxr) - (myl - cl / vxl * mxl), 2) AS effect,
        round(sqrt(nl * (vyl - cl / vxl * cl) / (nl - 2) * (1 / nl + mxl * mxl / (nl * vxl)) + nr * (vyr - cr / vxr * cr) / (nr - 2) * (1 / nr + mxr * mxr / (nr * vxr))), 2) AS se,
        round(h, 2) AS bandwidth, nl::BIGINT AS n_left, nr::BIGINT AS n_right, below, above FROM q""",
        "rdd_rows",
    ),
    "iv_2sls": with_views(
        """WITH q AS (SELECT count(*)::DOUBLE AS n, var_pop(z) AS vz, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(z, x) AS zx, covar_pop(z, y) AS zy, covar_pop(x, y) AS xy FROM iv_rows)
        SELECT round(zy / zx, 6) AS estimate, round(sqrt(n * (vy - 2 * zy / zx * xy + zy / zx * zy / zx * vx) / (n - 2) * vz / (n * zx * zx)), 6) AS se,
        round((zx / vz) * (zx / vz) * n * vz / (n * (vx - zx / vz * zx) / (n - 2)), 3) AS first_stage_f, n::BIGINT AS n FROM q""",
        "iv_rows",
    ),
    "ipw": with_views(
        """WITH cell AS (SELECT x, avg(d) AS e FROM ipw_rows GROUP BY x), r AS (SELECT i.*, e, d / e AS wt, (1 - d) / (1 - e) AS wc FROM ipw_rows i JOIN cell USING (x)),
        s AS (SELECT sum(wt * y) / sum(wt) AS mt, sum(wc * y) / sum(wc) AS mc, sum(wt) AS swt, sum(wc) AS swc, min(e) AS emin, max(e) AS emax, abs(sum(wt * x) / sum(wt) - sum(wc * x) / sum(wc)) / stddev_pop(x) AS smd FROM r)
        SELECT round(any_value(mt - mc), 4) AS ate, round(sqrt(sum((wt * (y - mt)) ** 2) / any_value(swt) ** 2 + sum((wc * (y - mc)) ** 2) / any_value(swc) ** 2), 4) AS se, round(any_value(emin), 4) AS e_min, round(any_value(emax), 4) AS e_max, round(any_value(smd), 4) AS max_smd FROM r, s""",
        "ipw_rows",
    ),
    "t_learner": with_views("SELECT x, round(avg(y) FILTER (WHERE d = 1) - avg(y) FILTER (WHERE d = 0), 4) AS cate, count(*) AS n FROM ipw_rows GROUP BY x", "ipw_rows"),
    "naive_diff": with_views("SELECT round(avg(y) FILTER (WHERE d = 1) - avg(y) FILTER (WHERE d = 0), 6) AS naive FROM ipw_rows", "ipw_rows"),
    "ols_slope": with_views("SELECT round(regr_slope(y, x), 6) AS slope FROM iv_rows", "iv_rows"),
    "ols_fit": with_views(
        """WITH q AS (SELECT count(*) AS n, var_pop(z) AS vz, var_pop(x) AS vx, covar_pop(z, x) AS zx, covar_pop(z, y) AS zy, covar_pop(x, y) AS xy FROM iv_rows)
        SELECT round((zy * vx - xy * zx) / (vz * vx - zx * zx), 4) AS b1, round((xy * vz - zy * zx) / (vz * vx - zx * zx), 4) AS b2, n FROM q""",
        "iv_rows",
    ),
}
