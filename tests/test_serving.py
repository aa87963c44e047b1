"""Batch scoring contract and stored drift profiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.profile import Profile
from tidewater.operators import churn, monitor, serving

GOOD = {"user_id": 1, "channel": "search", "plan": "pro", "tenure_days": 120, "txn_count_obs": 3, "total_spend_obs": 30.0, "avg_txn_amount_obs": 10.0, "days_since_last_txn": 4, "txn_freq_monthly": 0.75, "had_fraud_obs": 0, "signup_dow": 6, "signup_month": 12}


def requests(spark):
    """Strings throughout, as a file of requests has them."""
    changes = [{}, {"channel": "mail"}, {"plan": None}, {"user_id": -1}, {"tenure_days": 36_501}, {"tenure_days": 36_500, "signup_month": 1}, {"signup_month": 0, "signup_dow": 7}, {"total_spend_obs": "NaN"}, {"total_spend_obs": "Infinity"}, {"txn_count_obs": "2.5"}, {"txn_count_obs": "many"}, {"had_fraud_obs": 2}, {"avg_txn_amount_obs": -0.01}, {"txn_freq_monthly": None, "channel": None, "plan": ""}]
    rows = [{k: None if v is None else str(v) for k, v in {**GOOD, **{"user_id": 10 + n}, **c}.items()} for n, c in enumerate(changes)]
    want = [[], ["channel"], ["plan"], ["user_id"], ["tenure_days"], [], ["signup_dow", "signup_month"], ["total_spend_obs"], ["total_spend_obs"], ["txn_count_obs"], ["txn_count_obs"], ["had_fraud_obs"], ["avg_txn_amount_obs"], ["channel", "plan", "txn_freq_monthly"]]
    return spark.createDataFrame(pd.DataFrame(rows, dtype=object), ", ".join(f"{k} string" for k in GOOD)), rows, want


def test_every_request_is_scored_or_set_aside(spark):
    df, rows, want = requests(spark)
    got = serving.validate(df).collect()
    assert [r["reasons"] for r in got] == want
    r = np.random.default_rng(0)
    train = pd.DataFrame({c: r.integers(0, 2, 200).astype(float) for c in serving.Contract().features}).assign(churned=r.integers(0, 2, 200), user_id=range(200))
    model = churn.candidates(serving.Contract().features)["logistic"].fit(spark.createDataFrame(train))
    out = serving.score_batch(model, df, version="7")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    scored = out.collect()
    assert [x["reasons"] for x in scored] == want and {x["model_version"] for x in scored} == {"7"}
    assert all((x["churn_probability"] is None) == bool(w) and (x["churn_prediction"] is None) == bool(w) for x, w in zip(scored, want))
    plain = pd.DataFrame([{**{c: float(rows[0][c]) for c in churn.NUMERIC}, **{f"channel_{c}": float(c == "search") for c in churn.CHANNELS}, "plan_basic": 0.0, "plan_pro": 1.0, "user_id": 10}])
    p = churn.predict_churn(model, spark.createDataFrame(plain), serving.Contract().features).first()
    assert scored[0]["churn_probability"] == p["probability"] and scored[0]["churn_prediction"] == p["will_churn"]
    good, bad = serving.split(out)
    assert good.count() == want.count([]) and bad.count() == len(want) - want.count([])
    assert {x["field"]: x["n"] for x in serving.quarantine_report(out).collect()}["txn_count_obs"] == 2
    assert serving.score_batch(model, df.limit(0)).count() == 0


def test_the_frame_must_have_the_contracts_columns(spark):
    df, *_ = requests(spark)
    with pytest.raises(ValueError, match="missing"):
        serving.validate(df.drop("plan"))
    with pytest.raises(ValueError, match="unknown"):
        serving.validate(df.withColumn("note", F.lit("x")))


def frames(spark, seed=1):
    r = np.random.default_rng(seed)
    make = lambda n, shift: spark.createDataFrame(pd.DataFrame({"a": r.normal(shift, 1, n), "b": r.integers(0, 4, n).astype("int64"), "c": np.where(r.random(n) < 0.3, np.nan, r.gamma(2, 1, n)), "few": [1.0] * 5 + [np.nan] * (n - 5), "s": "x"}))
    return make(3000, 0), make(1700, 0.5)


def test_stored_profile_gives_the_same_drift(spark, tmp_path):
    ref, cur = frames(spark)
    clean = lambda df: df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    names = ["a", "b", "c", "few"]
    want = {r["column"]: (r["statistic"], r["drifted"]) for r in monitor.ks_drift(clean(ref), clean(cur), names).collect()}
    Profile.build(ref, names, f"file://{tmp_path}/p")
    stored = Profile(spark, f"file://{tmp_path}/p")  # as another session would open it
    got = {r["column"]: (r["statistic"], r["drifted"]) for r in monitor.ks_drift_profile(stored, cur, names).collect()}
    assert set(got) == {"a", "b", "c"} == set(want)
    assert all(got[c][0] == pytest.approx(want[c][0], abs=1e-12) and got[c][1] == want[c][1] for c in want)


def test_profiles_merge(spark, tmp_path):
    ref, cur = frames(spark)
    more, _ = frames(spark, 2)
    one, two = Profile.build(ref, ["a", "b"], f"file://{tmp_path}/1"), Profile.build(more, ["a", "b", "c"], f"file://{tmp_path}/2")
    both = one.merged(two, f"file://{tmp_path}/3")
    whole = Profile.build(ref.unionByName(more), ["a", "b"], f"file://{tmp_path}/4")
    got, want = (monitor.ks_drift_profile(p, cur, ["a", "b"]).orderBy("column").collect() for p in (both, whole))
    assert [(r["column"], round(r["statistic"], 12)) for r in got] == [(r["column"], round(r["statistic"], 12)) for r in want]


def test_monitor_reads_the_profile_only(spark, tmp_path):
    ref, cur = frames(spark)
    path = f"file://{tmp_path}/ref"
    ref.write.parquet(path)
    watch = monitor.DriftMonitor()
    assert watch.check(cur)["warning"]
    watch.set_reference(spark.read.parquet(path), f"file://{tmp_path}/profile")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
    got = watch.check(cur)
    assert got["drifted"] == ["a"] and got["any_drift"] and not watch.check(cur.where("a < 0.5"))["prediction_drift"]
