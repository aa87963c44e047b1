"""Command line: ``python -m tidewater build | metrics | causal-report | weekly-review | export-mmm | train-churn``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators import churn, report, semantic
from .plans import extras
from .session import session
from .sources import io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewater")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *options: tuple[str, str]) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for flag, default in options:
            p.add_argument(flag, default=default)
        return p

    here = ("--warehouse", "warehouse")
    add("build", "simulate a business, land its tables and build the marts", here, ("--truth", ""))
    m = add("metrics", "governed metrics, one row for each value of the dimensions", here)
    m.add_argument("metrics", nargs="+")
    m.add_argument("--by", nargs="*", default=[])
    for f in ("channel", "start_date", "end_date"):
        m.add_argument("--" + f.replace("_", "-"), dest=f)
    add("causal-report", "naive, causal and true effects of the scenarios")
    add("weekly-review", "the review as Markdown", here, ("--out", "weekly_review.md"))
    add("export-mmm", "fit the media mix and write its parameters", ("--out", "mmm_params.json"))
    add("train-churn", "choose, fit and store the churn model", here, ("--out", "churn_model"))
    return top


def run(spark: SparkSession, argv: Sequence[str]) -> str:
    """The text that the command prints."""
    o = parser().parse_args(argv)
    mart = lambda: io.scan(spark, o.warehouse, "marts", "mart_daily_channel")
    raw = lambda name: io.scan(spark, o.warehouse, "raw", name)
    if o.command == "build":
        counts = io.build_all(spark, extras.simulated_tables(spark, io.load_truth(o.truth) if o.truth else None), o.warehouse)
        return "\n".join(f"{k}: {n} rows" for k, n in counts.items())
    if o.command == "metrics":
        given = {k: getattr(o, k) for k in ("channel", "start_date", "end_date") if getattr(o, k)}
        return io.rows_json(semantic.compute_metrics(mart(), o.metrics, o.by, semantic.MetricFilters.parse(given)))
    if o.command == "causal-report":
        lines = [f"{'scenario':<16} {'method':<10} {'naive':>9} {'causal':>9} {'truth':>9}"]
        return "\n".join(lines + [f"{r.scenario:<16} {r.method:<10} {r.naive:>+9.4f} {r.causal:>+9.4f} {r.truth:>+9.4f}" for r in extras.causal_report(spark).collect()])
    if o.command == "weekly-review":
        got = report.build_weekly_review(mart(), raw("signups"), raw("transactions"))
        io.write_text(o.out, got.markdown)
        return f"{o.out}: {len(got.figures)} figures as of {got.as_of}"
    if o.command == "export-mmm":
        return f"{o.out}: {len(extras.exported_market(spark, o.out)['channels'])} channels"
    features = churn.feature_names()
    got = churn.train_pipeline(churn.churn_features(raw("signups"), raw("transactions"), raw("ad_spend_daily")), features)
    churn.save_bundle(got, o.out)
    return f"{o.out}: {got.name}, holdout AUC {got.metrics['roc_auc']:.4f} over {got.n_users} users"


def main() -> int:
    spark = session("tidewater")
    try:
        print(run(spark, sys.argv[1:]))
    except (io.WarehouseUnavailable, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
