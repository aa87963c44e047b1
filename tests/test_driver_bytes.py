"""What has a row for each user or order is not gathered on the driver, however small its files are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import churn, marts
from tidewater.sources import adapters as a
from tidewater.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["signups", "transactions", "ad_spend_daily", "panel", "rdd_rows", "ipw_rows"])
def test_views_merge(spark, view):
    plan = getattr(a, view)(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_users_merge(spark):
    day = dt.date(2024, 1, 1)
    users = spark.createDataFrame([(1, day, "search", True, "pro")], "user_id long, signup_date date, channel string, is_paid boolean, plan string")
    tx = spark.createDataFrame([(1, 1, day, 1.0, False), (2, 9, day, 1.0, False)], "txn_id long, user_id long, txn_date date, amount double, is_fraud boolean")
    fct = marts.fct_transactions(tx, users)
    assert "Broadcast" not in fct._jdf.queryExecution().executedPlan().toString() and fct.count() == 1
    late = tx.withColumn("txn_date", F.date_add("txn_date", 400))
    rows = churn.churn_features(users.withColumnRenamed("is_paid", "subscribed"), late)
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1
