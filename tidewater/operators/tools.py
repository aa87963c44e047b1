"""Tools over the warehouse for agents: every failure is a result with a code, every number has a source."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import io
from . import forecasting, marketing, report, semantic


@dataclass(frozen=True)
class ToolSpec:
    name: str
    description: str
    parameters: Mapping[str, Any]


@dataclass(frozen=True)
class ToolResult:
    ok: bool
    content: str
    data: Mapping[str, Any] = field(default_factory=dict)
    error_code: str | None = None

    def numeric_facts(self) -> set[float]:
        """Every number in the data, however deep; booleans are no numbers."""
        found: set[float] = set()

        def walk(x):
            if isinstance(x, bool):
                return
            if isinstance(x, (int, float)):
                found.add(float(x))
            elif isinstance(x, Mapping):
                for v in x.values():
                    walk(v)
            elif isinstance(x, (list, tuple)):
                for v in x:
                    walk(v)

        walk(self.data)
        return found


class Tool(Protocol):
    spec: ToolSpec

    def run(self, **arguments) -> ToolResult: ...


def failed(code: str, text: str) -> ToolResult:
    return ToolResult(False, text, {}, code)


class _Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def mart(self):
        return io.scan(self.spark, self.path, "marts", "mart_daily_channel")

    def safely(self, work) -> ToolResult:
        try:
            return work()
        except io.WarehouseUnavailable as e:
            return failed("WAREHOUSE_UNAVAILABLE", str(e))
        except PySparkException as e:
            return failed("WAREHOUSE_ERROR", str(e).splitlines()[0])


class QueryGrowthMetricsTool(_Warehouse):
    spec = ToolSpec("query_growth_metrics", "Governed metrics by channel and date with typed filters (channel, start_date, end_date).", {"metrics": list(semantic.METRICS), "by": sorted(semantic.DIMENSIONS), "filters": ["channel", "start_date", "end_date"]})

    def run(self, metrics=(), by=(), filters=None, where=None) -> ToolResult:
        if not metrics or any(m not in semantic.METRICS for m in metrics):
            return failed("INVALID_METRIC", f"metrics are: {', '.join(semantic.METRICS)}")
        if any(d not in semantic.DIMENSIONS for d in by) or len(set(by)) != len(by):
            return failed("INVALID_DIMENSION", "dimensions are channel and date, each named once")
        if where is not None:
            return failed("UNSAFE_FILTER", "filters are typed; SQL text is not accepted")
        try:
            f = semantic.MetricFilters.parse(filters or {})
        except (ValueError, TypeError) as e:
            return failed("INVALID_FILTER", str(e))

        def work():
            rows = json.loads(io.rows_json(semantic.compute_metrics(self.mart(), metrics, by, f)))
            sql, params = semantic.parameterized_metric_query(metrics, by, f)
            return ToolResult(True, f"{len(rows)} rows", {"rows": rows, "sql": sql, "params": [str(p) for p in params]})

        return self.safely(work)


class LtvSummaryTool(_Warehouse):
    spec = ToolSpec("ltv_summary", "Lifetime value by plan and channel.", {})

    def run(self) -> ToolResult:
        def work():
            users = io.scan(self.spark, self.path, "marts", "dim_users").withColumnRenamed("is_paid", "subscribed")
            tx = io.scan(self.spark, self.path, "marts", "fct_transactions")
            end = tx.agg(F.max("txn_date")).first()[0]
            if end is None:
                return failed("WAREHOUSE_EMPTY", "there are no transactions")
            est = marketing.ltv_frames(users, tx, end)
            plans = [{k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in est.plans.orderBy("plan").collect()]
            channels = [{k: round(v, 2) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in est.by_channel.collect()]
            return ToolResult(True, f"{len(plans)} plans", {"plans": plans, "by_channel": channels})

        return self.safely(work)


class ForecastRevenueTool(_Warehouse):
    spec = ToolSpec("forecast_revenue", "Daily revenue ahead by Holt-Winters.", {"horizon": "1 to 56 days"})

    def run(self, horizon: int = 14) -> ToolResult:
        if not isinstance(horizon, int) or isinstance(horizon, bool) or not 1 <= horizon <= 56:
            return failed("INVALID_HORIZON", "a horizon has 1 to 56 days")

        def work():
            series = report.daily_revenue(self.mart()).drop("date")
            if series.count() < 3 * forecasting.SEASON:
                return failed("INSUFFICIENT_HISTORY", "21 days of history at least are needed")
            rows = forecasting.forecast(series, "holt_winters", horizon).orderBy("h").collect()
            days = [round(r["forecast"], 2) for r in rows]
            return ToolResult(True, f"{horizon} days", {"daily": days, "total": round(sum(days), 2)})

        return self.safely(work)


class BudgetPlannerTool:
    spec = ToolSpec("plan_budget", "Best daily budget by channel from exported response parameters.", {"budget": "daily total"})

    def __init__(self, params_path: str):
        self.params_path = params_path

    def run(self, budget: float = 0.0) -> ToolResult:
        try:
            params = io.read_mmm(self.params_path)
            responses = [marketing.ChannelResponse(c, p["beta"], p["decay"], p["half_sat"]) for c, p in params.items()]
        except ValueError as e:
            return failed("INVALID_MMM_PARAMS", str(e))
        try:
            best = marketing.optimal_allocation(responses, float(budget))
        except (ValueError, TypeError) as e:
            return failed("INVALID_BUDGET", str(e))
        now = {c: p["mean_spend"] for c, p in params.items()}
        revenue = sum(r.revenue(now[r.name]) for r in responses)
        same = marketing.optimal_allocation(responses, sum(now.values())) if sum(now.values()) > 0 else best
        plan = dict(zip(best.channels, (round(x, 2) for x in best.daily_spend)))
        shift = max(plan, key=lambda c: abs(plan[c] - now[c]))
        data = {"plan": plan, "current": now, "expected_revenue": round(best.expected_revenue, 2), "current_revenue": round(revenue, 2), "uplift": round(best.expected_revenue - revenue, 2), "uplift_same_budget": round(same.expected_revenue - revenue, 2), "biggest_shift": shift}
        return ToolResult(True, f"largest change: {shift}", data)


def default_toolkit(spark: SparkSession, path: str, params_path: str) -> list[Tool]:
    return [QueryGrowthMetricsTool(spark, path), LtvSummaryTool(spark, path), ForecastRevenueTool(spark, path), BudgetPlannerTool(params_path)]
