"""Figures with provenance and the weekly review."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.settle import settle
from . import forecasting, marketing, risk, semantic

KPIS = ("spend", "signups", "paid_signups", "revenue")


def kpi_week_over_week(mart: DataFrame, kpis: tuple[str, ...] = KPIS) -> DataFrame:
    """metric, current (trailing 7 days), previous (the 7 before), change (0 where the previous is 0); one conditional aggregate."""
    last = mart.agg(F.max("date").alias("_last"))
    rows = mart.join(F.broadcast(last), F.col("date") > F.date_sub("_last", 14))  # one row
    late = F.col("date") > F.date_sub("_last", 7)
    total = lambda k, w: F.coalesce(F.sum(F.when(w, F.col(k))), F.lit(0)).cast("double")
    sums = rows.agg(*[F.struct(F.lit(k).alias("metric"), total(k, late).alias("current"), total(k, ~late).alias("previous")).alias(k) for k in kpis])
    out = sums.select(F.explode(F.array(*kpis)).alias("x")).select("x.*")
    change = F.when(F.col("previous") == 0, F.lit(0.0)).otherwise((F.col("current") - F.col("previous")) / F.col("previous"))
    return out.withColumn("change", change)


def fmt_scalar(value: float, unit: str) -> str:
    if unit == "$":
        return f"${value:,.0f}"
    if unit == "%":
        return f"{100 * value:.1f}%"
    if unit == "count":
        return f"{value:,.0f}"
    return f"{value:.2f}"


def frame_to_markdown(frame: pd.DataFrame) -> str:
    head = [f"| {' | '.join(map(str, frame.columns))} |", f"|{'---|' * len(frame.columns)}"]
    cell = lambda v: f"{v:,.2f}" if isinstance(v, float) else str(v)
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in row)} |" for row in frame.itertuples(index=False)])


@dataclass(frozen=True)
class Figure:
    """A value, its unit and where it came from."""

    slug: str
    value: object
    unit: str
    source: str

    def __post_init__(self):
        if not self.source.strip():
            raise ValueError(f"figure {self.slug} has no source")

    def text(self) -> str:
        return frame_to_markdown(self.value) if isinstance(self.value, pd.DataFrame) else fmt_scalar(float(self.value), self.unit)


class FigureRegistry:
    def __init__(self):
        self.figures: dict[str, Figure] = {}

    def add(self, slug: str, value: object, unit: str, source: str) -> Figure:
        if slug in self.figures:
            raise ValueError(f"figure {slug} is registered twice")
        self.figures[slug] = Figure(slug, value, unit, source)
        return self.figures[slug]

    def __getitem__(self, slug: str) -> Figure:
        return self.figures[slug]


@dataclass(frozen=True)
class GrowthReview:
    as_of: dt.date
    markdown: str
    figures: dict[str, Figure]


def channel_table(mart: DataFrame, start: dt.date, end: dt.date) -> tuple[DataFrame, str]:
    names, window = ["spend", "signups", "paid_signups", "cac", "revenue"], semantic.MetricFilters(start_date=start, end_date=end)
    return semantic.compute_metrics(mart, names, ["channel"], window), semantic.parameterized_metric_query(names, ["channel"], window)[0]


def daily_revenue(mart: DataFrame) -> DataFrame:
    """key, t, y by date, in order; one row for each day."""
    from pyspark.sql import Window

    days = mart.groupBy("date").agg(F.sum("revenue").alias("y"))
    return days.select(F.lit("revenue").alias("key"), (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("t"), "y", "date")


def build_weekly_review(mart: DataFrame, signups: DataFrame, transactions: DataFrame, horizon: int = 14) -> GrowthReview:
    """KPIs against the week before, channels, lifetime value, forecast and anomalies as of the mart's last date."""
    mart = settle(mart)
    as_of = mart.agg(F.max("date")).first()[0]
    if as_of is None:
        raise ValueError("the mart is empty")
    start = as_of - dt.timedelta(days=6)
    reg = FigureRegistry()
    text = semantic.parameterized_metric_query(list(KPIS), (), semantic.MetricFilters(start_date=start, end_date=as_of))[0]
    for r in kpi_week_over_week(mart).collect():
        reg.add(f"kpi_{r['metric']}", r["current"], "$" if r["metric"] in ("spend", "revenue") else "count", text)
        reg.add(f"kpi_{r['metric']}_change", r["change"], "%", text)
    table, sql = channel_table(mart, start, as_of)
    reg.add("channels", table.toPandas(), "table", sql)
    ltv = marketing.ltv_frames(signups, transactions, as_of)
    reg.add("ltv", ltv.by_channel.toPandas(), "table", "geometric lifetimes by plan over marts.fct_transactions")
    series = settle(daily_revenue(mart))
    if series.count() >= 3 * forecasting.SEASON:
        ahead = forecasting.forecast(series.drop("date"), "holt_winters", horizon).agg(F.sum("forecast")).first()[0]
        reg.add("forecast_revenue", ahead, "$", f"Holt-Winters over daily revenue of {semantic.MART}, {horizon} days")
        odd = risk.mad_scores(series.select("t", "y")).where("flagged").join(series.select("t", "date"), "t").orderBy("date").select("date", "score").toPandas()
        reg.add("anomalies", odd, "table", f"median decomposition of daily revenue of {semantic.MART}")
    return GrowthReview(as_of, _render(as_of, start, reg), dict(reg.figures))


def figure_values(review: GrowthReview) -> list[tuple[str, str, float]]:
    """(slug, item, value) of every number in the review; an item of a table is its row's name, with the column's where there are several."""
    out = []
    for slug, figure in review.figures.items():
        if not isinstance(figure.value, pd.DataFrame):
            out.append((slug, "", float(figure.value)))
            continue
        name, *columns = figure.value.columns
        for row in figure.value.to_dict("records"):
            out += [(slug, f"{row[name]}" if len(columns) == 1 else f"{row[name]}.{c}", float(row[c])) for c in columns if pd.notna(row[c])]
    return out


def _render(as_of: dt.date, start: dt.date, reg: FigureRegistry) -> str:
    lines = [f"# Weekly review, {start} to {as_of}", ""]
    lines += [f"- {k}: {reg[f'kpi_{k}'].text()} ({reg[f'kpi_{k}_change'].text()} on the week before)" for k in KPIS]
    for slug, title in (("channels", "Channels"), ("ltv", "Lifetime value"), ("forecast_revenue", "Forecast revenue"), ("anomalies", "Anomalous days")):
        if slug in reg.figures:
            lines += ["", f"## {title}", "", reg[slug].text(), "", f"Source: {reg[slug].source}"]
    return "\n".join(lines) + "\n"


def write_pptx(review: GrowthReview, path: str) -> None:
    """The figures on slides; needs python-pptx, which is optional."""
    try:
        from pptx import Presentation
    except ImportError as e:
        raise RuntimeError("python-pptx is not installed") from e
    deck = Presentation()
    for title, slugs in (("Weekly review", [s for s in review.figures if s.startswith("kpi_")]), ("Channels", ["channels"]), ("Lifetime value", ["ltv"]), ("Forecast", ["forecast_revenue"]), ("Anomalies", ["anomalies"])):
        slide = deck.slides.add_slide(deck.slide_layouts[1])
        slide.shapes.title.text = title
        slide.placeholders[1].text = "\n".join(f"{s}: {review.figures[s].text()}" for s in slugs if s in review.figures)
    deck.save(path)
