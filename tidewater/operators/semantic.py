"""Governed metric layer: metric names and dimensions compile to SQL text and to DataFrame aggregates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = frozenset({"channel", "date"})
MART = "marts.mart_daily_channel"


@dataclass(frozen=True)
class Metric:
    """Sum of a measure, or a ratio of two sums (null where the denominator is zero)."""

    name: str
    numerator: str
    denominator: str | None = None

    def sql(self) -> str:
        if self.denominator is None:
            return f"SUM({self.numerator})"
        return f"CAST(SUM({self.numerator}) AS DOUBLE) / NULLIF(SUM({self.denominator}), 0)"

    def column(self) -> Column:
        top = F.sum(self.numerator)
        if self.denominator is None:
            return top.alias(self.name)
        return (top.cast("double") / F.nullif(F.sum(self.denominator), F.lit(0))).alias(self.name)


METRICS = {
    m.name: m
    for m in (
        *(Metric(n, n) for n in ("spend", "impressions", "clicks", "signups", "paid_signups", "txns", "revenue", "fraud_txns")),
        Metric("ctr", "clicks", "impressions"),
        Metric("cvr", "signups", "clicks"),
        Metric("cpc", "spend", "clicks"),
        Metric("cac", "spend", "paid_signups"),
        Metric("trial_to_paid", "paid_signups", "signups"),
        Metric("fraud_rate", "fraud_txns", "txns"),
        Metric("arpu", "revenue", "paid_signups"),
    )
}


@dataclass(frozen=True)
class MetricFilters:
    """Typed filters; values never enter SQL text."""

    channel: str | None = None
    start_date: dt.date | None = None
    end_date: dt.date | None = None

    def __post_init__(self):
        if self.channel is not None and not (self.channel.strip() and len(self.channel) <= 128):
            raise ValueError("channel must not be blank and has 128 characters at most")
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise ValueError("start_date is after end_date")

    @classmethod
    def parse(cls, values: Mapping[str, object]) -> MetricFilters:
        if unknown := set(values) - {"channel", "start_date", "end_date"}:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        out: dict = {}
        for k, v in values.items():
            if v is None:
                continue
            if not isinstance(v, (str, dt.date)):
                raise ValueError(f"{k} must be text")
            out[k] = v if k == "channel" or isinstance(v, dt.date) else dt.date.fromisoformat(v)
        return cls(**out)

    def clauses(self) -> list[tuple[str, object]]:
        pairs = (("channel = ?", self.channel), ("date >= ?", self.start_date), ("date <= ?", self.end_date))
        return [(text, v) for text, v in pairs if v is not None]

    def condition(self) -> Column:
        tests = F.lit(True)
        if self.channel is not None:
            tests = tests & (F.col("channel") == F.lit(self.channel))
        if self.start_date:
            tests = tests & (F.col("date") >= F.lit(self.start_date))
        if self.end_date:
            tests = tests & (F.col("date") <= F.lit(self.end_date))
        return tests


def _checked(metrics: Sequence[str], by: Sequence[str]) -> None:
    if not metrics:
        raise ValueError("name one metric at least")
    for m in metrics:
        if m not in METRICS:
            raise KeyError(f"unknown metric {m}")
    if bad := [d for d in by if d not in DIMENSIONS]:
        raise ValueError(f"unknown dimensions: {bad}")
    if len(set(by)) != len(by):
        raise ValueError("a dimension is named twice")


def _text(metrics: Sequence[str], by: Sequence[str], where: str) -> str:
    columns = [*by, *(f"{METRICS[m].sql()} AS {m}" for m in metrics)]
    dims = ", ".join(by)
    return f"SELECT {', '.join(columns)} FROM {MART}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {dims} ORDER BY {dims}" if by else "")


def metric_query(metrics: Sequence[str], by: Sequence[str] = (), where: str | None = None) -> str:
    """SQL text, kept for lineage; ``where`` is trusted text from internal callers only."""
    _checked(metrics, by)
    return _text(metrics, by, where or "")


def parameterized_metric_query(metrics: Sequence[str], by: Sequence[str] = (), filters: MetricFilters | None = None) -> tuple[str, tuple]:
    _checked(metrics, by)
    pairs = (filters or MetricFilters()).clauses()
    return _text(metrics, by, " AND ".join(t for t, _ in pairs)), tuple(v for _, v in pairs)


def compute_metrics(mart: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), filters: MetricFilters | None = None, where: str | None = None) -> DataFrame:
    """Dimensions, then metrics, in the order asked. Without dimensions there is always one row."""
    _checked(metrics, by)
    if filters is not None and where is not None:
        raise ValueError("filters and where exclude each other")
    rows = mart.where(where) if where else mart.where(filters.condition()) if filters else mart
    aggs = [METRICS[m].column() for m in metrics]
    if not by:
        return rows.agg(*aggs)
    return rows.groupBy(*by).agg(*aggs).orderBy(*[F.col(d).asc_nulls_last() for d in by])
