"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidewater", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the submitted session instead.

    UTC makes DATE casts of NTZ timestamps independent of the host; AQE re-plans joins and
    splits skewed partitions at run time.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
