"""Recovery of known effects, refusals, decision rules, and the warehouse end to end."""

import ast
import datetime as dt
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import causal, churn, experiments, forecasting, marketing, marts, monitor, report, risk, semantic, sim, tools
from tidewater.sources import io

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def out(spark):
    return sim.simulate(spark)


@pytest.fixture(scope="session")
def warehouse(spark, out, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warehouse"))
    io.build_all(spark, {"ad_spend_daily": out.ad_spend_daily, "signups": out.signups, "transactions": out.transactions}, path)
    return path


@pytest.fixture(scope="session")
def mart(spark, warehouse):
    return io.scan(spark, warehouse, "marts", "mart_daily_channel").cache()


# -- simulator and warehouse


def test_simulator_follows_its_truth(out):
    t = sim.DEFAULT
    for r in out.ad_spend_daily.groupBy("channel").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i")).collect():
        assert abs(r["c"] / r["i"] / t.channels[r["channel"]]["ctr"] - 1) < 0.05
    s = out.signups
    assert s.count() == s.select("user_id").distinct().count() == s.agg(F.max("user_id")).first()[0] + 1
    assert s.where("subscribed <> (plan IS NOT NULL)").count() == 0
    late = out.transactions.join(s, "user_id").where("txn_date < signup_date").count()
    assert late == 0
    assert out.signups.exceptAll(sim.simulate(out.signups.sparkSession).signups).count() == 0


def test_mart_reconciles(spark, out, mart):
    tot = semantic.compute_metrics(mart, ["signups", "paid_signups", "txns", "revenue", "spend"]).first()
    assert tot["signups"] == out.signups.count() and tot["paid_signups"] == out.signups.where("subscribed").count()
    assert tot["txns"] == out.transactions.count()
    assert tot["revenue"] == pytest.approx(out.transactions.agg(F.sum("amount")).first()[0])
    assert mart.count() == mart.select("date", "channel").distinct().count()
    s = marts.stg_signups(out.signups)
    fct = marts.fct_transactions(out.transactions, marts.dim_users(s))
    other = marts.mart_daily_channel_joined(out.ad_spend_daily, s, fct)
    rounded = lambda df: df.select("date", "channel", *[F.round(m, 4).cast("double").alias(m) for m in marts.MEASURES])
    assert rounded(other).exceptAll(rounded(mart)).count() == 0


def test_metric_layer_rules(mart):
    with pytest.raises(KeyError):
        semantic.metric_query(["nope"])
    with pytest.raises(ValueError):
        semantic.metric_query([])
    with pytest.raises(ValueError):
        semantic.metric_query(["spend"], ["channel", "channel"])
    with pytest.raises(ValueError):
        semantic.compute_metrics(mart, ["spend"], filters=semantic.MetricFilters(), where="1 = 1")
    with pytest.raises(ValueError):
        semantic.MetricFilters.parse({"chanel": "x"})
    with pytest.raises(ValueError):
        semantic.MetricFilters(channel=" ")
    nobody = semantic.MetricFilters(channel="x' OR 1 = 1 --")
    assert semantic.compute_metrics(mart, ["spend", "ctr"], filters=nobody).collect() == [(None, None)]
    assert semantic.compute_metrics(mart, ["spend"], ["channel"], nobody).collect() == []
    sql, params = semantic.parameterized_metric_query(["ctr"], ["channel"], nobody)
    assert "OR 1" not in sql and params == (nobody.channel,)
    df = semantic.compute_metrics(mart, ["ctr", "cvr", "clicks", "impressions"], ["channel"])
    assert df.columns == ["channel", "ctr", "cvr", "clicks", "impressions"]
    for r in df.collect():
        assert (r["ctr"] is None) == (r["impressions"] == 0) and (r["ctr"] is None or abs(r["ctr"] - r["clicks"] / r["impressions"]) < 1e-12)


# -- experiments


def test_power_and_assignment(spark):
    n = experiments.required_n_per_arm(0.1, 0.1)
    assert 14_000 < n < 15_500
    assert experiments.minimum_detectable_effect(n, 0.1) == pytest.approx(0.1, rel=1e-3)
    with pytest.raises(ValueError):
        experiments.required_n_per_arm(0.1, -0.1)
    with pytest.raises(ValueError):
        experiments.minimum_detectable_effect(1, 0.1)
    got = spark.range(3000).select("id", stats.assign_arm("x", F.col("id"), 7).alias("a")).collect()
    assert all(r["a"] == stats.assign_arm_value("x", r["id"], 7) for r in got)


def test_boundaries_and_sequences(spark):
    want = (4.877, 3.357, 2.680, 2.290, 2.031)
    got = experiments.obf_boundaries(5)
    assert abs(got[0] / want[0] - 1) < 0.06 and all(abs(g / w - 1) < 0.02 for g, w in zip(got[1:], want[1:]))
    design = experiments.SequentialDesign(tuple(got))
    assert design.first_crossing([0, 0, 3, 0, 9]) == 3 and design.first_crossing([0] * 5) is None
    with pytest.raises(ValueError):
        design.first_crossing([1.0])


def test_decisions():
    g = experiments.GuardrailSpec("kept", 0.02)
    d = experiments.ExperimentDesign("x", 0.1, 0.1, guardrails=(g,))
    arm = lambda n, x, k: experiments.ArmCounts(n, x, {"kept": k})
    run = lambda a, b: experiments.evaluate(d, a, b).decision
    assert run(arm(20_000, 2000, 18_000), arm(10_000, 1000, 9000)) is experiments.Decision.INVALID
    assert run(arm(20_000, 2000, 18_000), arm(20_000, 2300, 18_000)) is experiments.Decision.LAUNCH
    assert run(arm(20_000, 2000, 18_000), arm(20_000, 1700, 18_000)) is experiments.Decision.NO_LAUNCH
    assert run(arm(2000, 200, 1800), arm(2000, 205, 1800)) is experiments.Decision.CONTINUE
    assert run(arm(20_000, 2000, 18_000), arm(20_000, 2300, 16_000)) is experiments.Decision.NO_LAUNCH
    with pytest.raises(KeyError):
        experiments.evaluate(d, experiments.ArmCounts(10_000, 1000), experiments.ArmCounts(10_000, 1000))
    assert "95% CI" in experiments.to_markdown(experiments.evaluate(d, arm(20_000, 2000, 18_000), arm(20_000, 2300, 18_000)))


def test_false_positive_rate_and_cuped(spark):
    rng, hits, sims = np.random.default_rng(0), 0, 2000
    for _ in range(sims):
        a, b = rng.binomial(5000, 0.1, 2)
        hits += experiments.two_proportion_ztest(a, 5000, b, 5000).significant
    assert abs(hits / sims - 0.05) < 4 * math.sqrt(0.05 * 0.95 / sims)
    x = rng.normal(0, 1, 4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + rng.normal(0, 1, 4000), "arm": rng.integers(0, 2, 4000)}))
    adj = experiments.cuped_adjust(df, "y", "x")
    v = adj.agg(F.var_samp("y").alias("a"), F.var_samp("y_cuped").alias("b")).first()
    assert abs(v["b"] / v["a"] - 0.2) < 0.03


# -- causal


def test_did(spark):
    pdf, truth = sim.geo_rollout()
    df = spark.createDataFrame(pdf)
    assert abs(causal.diff_in_diff(df).att - truth) < 0.002
    assert abs(causal.naive_difference(df.where("post").withColumn("d", F.col("treated").cast("int")), "d", "y") - truth) > 0.005
    with pytest.raises(causal.AssumptionViolation):
        causal.diff_in_diff(spark.createDataFrame(sim.geo_rollout(broken=True)[0]))
    with pytest.raises(ValueError):
        causal.diff_in_diff(df.drop("post"))


def test_rdd(spark):
    pdf, truth = sim.spend_threshold()
    assert abs(causal.sharp_rdd(spark.createDataFrame(pdf), "running", "outcome", 0.3).effect - truth) < 0.04
    with pytest.raises(causal.AssumptionViolation):
        causal.sharp_rdd(spark.createDataFrame(sim.spend_threshold(broken=True)[0]), "running", "outcome", 0.3)


def test_ipw_and_uplift(spark):
    pdf, truth = sim.promo_email()
    df = spark.createDataFrame(pdf).cache()
    x = ["engagement", "tenure"]
    assert abs(causal.ipw_ate(df, x, "treated", "outcome").ate - truth) < 0.03
    assert causal.naive_difference(df, "treated", "outcome") > truth + 0.04
    assert abs(causal.segment_effect(causal.t_learner(df, x, "treated", "outcome"), F.lit(True)) - truth) < 0.03
    with pytest.raises(causal.AssumptionViolation):
        causal.ipw_ate(spark.createDataFrame(sim.promo_email(broken=True)[0]), x, "treated", "outcome")


def test_iv_and_ols(spark):
    pdf, truth = sim.price_instrument()
    df = spark.createDataFrame(pdf)
    r = causal.two_stage_least_squares(df, "instrument", "price", "demand")
    assert abs(r.estimate - truth) < 0.08 and r.first_stage_f > 100
    assert causal.naive_ols_slope(df, "price", "demand") > 0.5
    with pytest.raises(causal.AssumptionViolation):
        causal.two_stage_least_squares(spark.createDataFrame(sim.price_instrument(broken=True)[0]), "instrument", "price", "demand")
    fit = causal.ols(df, ["instrument", "price"], "demand")
    a = np.column_stack([np.ones(len(pdf)), pdf[["instrument", "price"]]])
    beta = np.linalg.lstsq(a, pdf["demand"], rcond=None)[0]
    s2 = ((pdf["demand"] - a @ beta) ** 2).sum() / (len(pdf) - 3)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.se, np.sqrt(np.diag(s2 * np.linalg.inv(a.T @ a))))


# -- marketing


def test_attribution(spark):
    pdf, added = sim.journey_paths(n=8000)
    df = spark.createDataFrame(pdf).cache()
    total = df.where("converted").count()
    last = {r["channel"]: r["credit"] for r in marketing.last_touch(df).collect()}
    linear = {r["channel"]: r["credit"] for r in marketing.linear_touch(df).collect()}
    markov = marketing.markov_removal(df, list(added))
    assert sum(last.values()) == total and sum(linear.values()) == pytest.approx(total) and sum(markov.values()) == pytest.approx(total)
    assert last["display"] > 3 * added["display"] and markov["display"] < last["display"]
    with pytest.raises(ValueError):
        marketing.markov_removal(df.withColumn("converted", F.lit(False)), ["display"])


def test_ltv(out):
    end = out.transactions.agg(F.max("txn_date")).first()[0]
    est = marketing.fit_geometric_ltv(out.signups, out.transactions, end)
    for name, p in sim.DEFAULT.plans.items():
        got = est.plan(name)
        assert got.price == p["price"] and abs(got.monthly_churn / p["churn"] - 1) < 0.35
    with pytest.raises(KeyError):
        est.plan("gold")
    with pytest.raises(ValueError):
        marketing.fit_geometric_ltv(out.signups, out.transactions.limit(1), end)


def test_media_mix_and_budget(spark, tmp_path):
    spend, revenue, dow, truth = sim.mmm_market()
    fit = marketing.fit_mmm(spark, spend, revenue, dow, ["a", "b", "c", "d"])
    got = fit.roas(spend)
    assert all(abs(got[c] / truth["roas"][k] - 1) < 0.2 for k, c in enumerate(fit.channels))
    ci = {r["channel"]: r for r in marketing.bootstrap_roas(spark, fit, spend, revenue, dow, 40).collect()}
    assert all(ci[c]["low"] < got[c] < ci[c]["high"] for c in fit.channels)
    path = str(tmp_path / "mmm.json")
    io.export_mmm(fit, spend.mean(axis=0), path)
    r = [marketing.ChannelResponse(c, v["beta"], v["decay"], v["half_sat"]) for c, v in io.read_mmm(path).items()]
    best = marketing.optimal_allocation(r, 500.0)
    rng = np.random.default_rng(0)
    rest = max(sum(x.revenue(s) for x, s in zip(r, 500 * w)) for w in rng.dirichlet(np.ones(4), 3000))
    assert sum(best.daily_spend) == pytest.approx(500) and best.expected_revenue >= rest - 1e-6
    assert r[0].spend_at_marginal(r[0].marginal(100.0)) == pytest.approx(100.0)
    plan = tools.BudgetPlannerTool(path)
    assert plan.run(budget=500.0).ok and plan.run(budget=-1).error_code == "INVALID_BUDGET"
    io.write_text(path, "{}")
    assert plan.run(budget=1.0).error_code == "INVALID_MMM_PARAMS"


# -- forecasting and risk


def test_forecast_gates(spark):
    y = sim.daily_series(shocks=0)[0]["y"].to_numpy()
    hw = forecasting.rolling_origin_backtest(spark, y, "holt_winters", 400)
    assert hw.mase < 0.8 and hw.beats_baseline
    assert forecasting.rolling_origin_backtest(spark, y, "boosted_stumps", 400).mase < 1
    assert forecasting.rolling_origin_backtest(spark, y, "seasonal_naive", 400).mase == pytest.approx(1)
    with pytest.raises(ValueError):
        forecasting.HoltWinters().fit(y[:20])


def test_no_leakage_in_folds(spark):
    class Spy:
        def fit(self, y):
            self.n = len(y)
            return self

        def predict(self, horizon):
            return np.full(horizon, float(self.n))

    df = spark.createDataFrame(pd.DataFrame({"key": "k", "t": np.arange(200), "y": np.arange(200.0)}))
    rows = forecasting.backtest_rows(df, Spy, 100, 14, 28).collect()
    assert rows and all(r["forecast"] == r["origin"] and r["y"] == r["origin"] + r["h"] - 1 for r in rows)


def test_naive_native_and_bottom_up(spark):
    df = spark.createDataFrame(pd.DataFrame({"key": np.repeat(["a", "b"], 30), "t": np.tile(np.arange(30), 2), "y": np.arange(60.0)}))
    a = forecasting.seasonal_naive_native(df, 10).orderBy("key", "h").collect()
    b = forecasting.forecast(df, "seasonal_naive", 10).orderBy("key", "h").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    up = forecasting.bottom_up_forecast(df, "seasonal_naive", 3).toPandas()
    by = up.groupby(["h", up["key"] == "total"])["forecast"].sum().unstack()
    assert np.allclose(by[True], by[False])


def test_anomalies(spark):
    pdf, shocks = sim.daily_series()
    df = spark.createDataFrame(pdf)
    flagged = {r["t"] for r in risk.mad_residual_detector(df).where("flagged").collect()}
    assert len(flagged & set(shocks)) >= 0.8 * len(shocks) and len(flagged & set(shocks)) >= 0.8 * len(flagged)
    iso = {r["t"] for r in risk.isolation_forest_detector(spark, df, 24).collect()}
    assert len(iso & set(shocks)) >= 0.6 * len(shocks)


def test_scores_and_drift(spark):
    pdf = sim.fraud_transactions()
    x = ["amount_z", "velocity", "country_mismatch", "night"]
    df = spark.createDataFrame(pdf)
    beta = causal.fit_logistic(df.limit(15_000), x, "is_fraud")
    s = df.select(F.col("is_fraud").alias("label"), causal.sigmoid(causal.linear_predictor(x, beta)).alias("p")).cache()
    assert risk.auc(s) > 0.75 and risk.expected_calibration_error(risk.reliability_curve(s)) < 0.02
    t, cost = risk.cost_optimal_threshold(s, 1.0, 10.0)
    assert abs(t - 1 / 11) < 0.05
    p = s.toPandas()
    assert cost == min(((p["p"] >= c) & (p["label"] == 0)).sum() + 10 * ((p["p"] < c) & (p["label"] == 1)).sum() for c in np.unique(np.concatenate([[0, 1], p["p"].round(4)])))
    psi, status = risk.population_stability_index(df, spark.createDataFrame(sim.fraud_transactions(shifted=True)), "velocity")
    assert status == "alarm" and risk.population_stability_index(df, spark.createDataFrame(sim.fraud_transactions(seed=9)), "velocity")[1] == "stable"
    assert psi > 0.25
    with pytest.raises(ValueError):
        risk.auc(s.where("label = 0"))
    one = spark.createDataFrame([(1, 1.0), (0, 0.55)], "label int, p double")
    assert risk.reliability_curve(one).count() == 1 and risk.reliability_curve(one, close_last=True).count() == 2


def test_monitoring(spark):
    rng = np.random.default_rng(0)
    ref = spark.createDataFrame(pd.DataFrame({"a": rng.normal(0, 1, 100), "b": rng.normal(0, 1, 100)}))
    cur = spark.createDataFrame(pd.DataFrame({"a": rng.normal(2, 1, 100), "b": ref.toPandas()["b"]}))
    m = monitor.DriftMonitor()
    assert m.check(cur)["warning"]
    m.set_reference(ref)
    assert m.check(cur)["drifted"] == ["a"]
    assert monitor.calibration_check(spark.createDataFrame([(0.5, 1)] * 5, "p double, label int"))["warning"]
    tx = spark.createDataFrame([(dt.date(2025, 1, 1),)], "txn_date date")
    assert monitor.data_freshness(tx, dt.datetime(2025, 1, 2))["fresh"] and not monitor.data_freshness(tx, dt.datetime(2025, 1, 4))["fresh"]
    lat = spark.createDataFrame([("x", k / 1000, k == 1, k, k) for k in range(1, 101)], "endpoint string, latency double, error boolean, ts long, event_id long")
    r = monitor.latency_report(lat).first()
    assert (r["p50"], r["p95"], r["p99"], r["n"]) == (51.0, 96.0, 100.0, 100)


# -- churn, review, tools


def test_churn_pipeline(spark, out, tmp_path):
    names = churn.feature_names()
    assert len(names) == 16
    rows = churn.churn_features(out.signups, out.transactions, out.ad_spend_daily, 60, 30).cache()
    got = churn.train_pipeline(rows, names, names=("logistic",))
    assert 0 <= got.metrics["roc_auc"] <= 1 and set(got.importance) == set(names)
    path = str(tmp_path / "bundle")
    churn.save_bundle(got, path)
    model, card = churn.load_bundle(path, names)
    assert churn.predict_churn(model, rows, names).count() == rows.count() and card["model"] == "logistic"
    with pytest.raises(ValueError):
        churn.load_bundle(path, names[:-1])
    with open(f"{path}/card.json") as f:
        card = json.load(f)
    card["sha256"] = "0"
    io.write_text(f"{path}/card.json", json.dumps(card))
    with pytest.raises(ValueError):
        churn.load_bundle(path, names)
    with pytest.raises(ValueError):
        churn.train_pipeline(rows.limit(50), names)


def test_review_and_tools(spark, out, mart, warehouse, tmp_path):
    review = report.build_weekly_review(mart, out.signups, out.transactions)
    assert "Forecast revenue" in review.markdown and all(f.source.strip() for f in review.figures.values())
    with pytest.raises(ValueError):
        report.Figure("x", 1.0, "$", " ")
    reg = report.FigureRegistry()
    reg.add("x", 1.0, "$", "s")
    with pytest.raises(ValueError):
        reg.add("x", 1.0, "$", "s")
    q, ltv, fc, _ = tools.default_toolkit(spark, warehouse, "none.json")
    assert q.run(metrics=["spend"], by=["channel"]).ok and q.run(metrics=["spend"]).numeric_facts()
    codes = [q.run(metrics=["x"]), q.run(metrics=["spend"], by=["channel", "channel"]), q.run(metrics=["spend"], where="1=1"), q.run(metrics=["spend"], filters={"start_date": "no"})]
    assert [c.error_code for c in codes] == ["INVALID_METRIC", "INVALID_DIMENSION", "UNSAFE_FILTER", "INVALID_FILTER"]
    assert ltv.run().ok and fc.run(14).ok and fc.run(99).error_code == "INVALID_HORIZON"
    assert tools.QueryGrowthMetricsTool(spark, str(tmp_path)).run(metrics=["spend"]).error_code == "WAREHOUSE_UNAVAILABLE"


def test_stream_equals_batch(spark, tmp_path):
    from tidewater.streaming import metrics

    src = "/root/testdata/sf0.001/events.parquet"
    folder = str(tmp_path / "in")
    spark.read.parquet(src).repartition(3).write.parquet(folder)
    stream = metrics.windowed_counts(metrics.event_stream(spark, folder), late="3650 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.windowed_counts(metrics.with_instants(spark.read.parquet(src)))
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(batch)


def test_seal():
    """Engine modules never import the simulator, and nothing outside the subpackage imports the corpus operators."""
    for top, _, files in os.walk(os.path.join(ROOT, "tidewater")):
        for f in files:
            path = os.path.join(top, f)
            if not f.endswith(".py") or os.sep + "llm" in path:
                continue
            with open(path) as g:
                tree = ast.parse(g.read())
            names = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {f"{n.module or ''}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
            assert not any("llm" in n for n in names), path
            if not path.endswith(("sim.py", "extras.py")):
                assert not any(n.endswith("sim") or ".sim." in n for n in names), path


def test_queries_run_operators_with_their_defaults(spark, monkeypatch):
    import inspect

    from tidewater.operators import churn, forecasting, marketing, risk
    from tidewater.plans import extras, forecast
    from tidewater.plans import marketing as marketing_plans
    from tidewater.plans import risk as risk_plans

    class Called(Exception):
        pass

    def watch(module, name, given):
        real = inspect.signature(getattr(module, name))

        def stub(*args, **options):
            bound = real.bind(*args, **options)
            bound.apply_defaults()
            got = dict(bound.arguments) | dict(bound.arguments.get("options", {}))
            for key, value in given.items():
                assert got.get(key, value) == value, (name, key)
            raise Called

        monkeypatch.setattr(module, name, stub)

    d = "/root/testdata/sf0.001"
    watch(forecasting, "backtest_rows", {"step": 28})
    watch(churn, "train_pipeline", {"names": None})
    watch(marketing, "bootstrap_roas", {"n_boot": 200})
    watch(risk, "isolation_forest_detector", {"n_trees": 200})
    queries = [forecast.QUERIES[q] for q in ("backtest_naive", "backtest_holt_winters", "churn_model_scores", "churn_model_metrics")] + [risk_plans.QUERIES["isolation_forest"]]
    for q in queries:
        with pytest.raises(Called):
            q(spark, d)
    with monkeypatch.context() as part:
        part.setattr(marketing_plans, "_fit", lambda s, d: (None,) * 4)
        with pytest.raises(Called):
            marketing_plans.QUERIES["roas_bootstrap"](spark, d)
    watch(marketing, "fit_mmm", {"n_rounds": 3})
    for q in (marketing_plans.QUERIES["mmm_fit"], extras.QUERIES["mmm_scenario"]):
        with pytest.raises(Called):
            q(spark, d)
    got = marketing_plans.QUERIES["adstock_channels"](spark, d)
    one = marketing_plans.QUERIES["adstock"](spark, d)
    assert sorted(got.where("channel = 'building'").select("date", "stock").collect()) == sorted(one.collect())
    assert got.select("channel").distinct().count() > 1
