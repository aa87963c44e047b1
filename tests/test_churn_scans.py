"""The churn queries run the joins of their input once: what is split, fitted and scored is a table that was written."""

from types import SimpleNamespace

import pytest

from tidewater.operators import churn
from tidewater.plans import forecast

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["churn_model_scores", "churn_model_metrics"])
def test_training_rows_are_made_once(spark, monkeypatch, name):
    made, seen = [], []
    rows = forecast.training
    monkeypatch.setattr(forecast, "training", lambda *x: made.append(x) or rows(*x))
    monkeypatch.setattr(churn, "train_pipeline", lambda df, features: seen.append(df) or SimpleNamespace(model=None, metrics={"roc_auc": 0.5}))
    monkeypatch.setattr(churn, "predict_churn", lambda model, df, features: seen.append(df) or df)
    forecast.QUERIES[name](spark, SF).collect()
    assert len(made) == 1 and seen
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and df.count() == rows(spark, SF).count() > 0
