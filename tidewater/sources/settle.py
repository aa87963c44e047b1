"""Intermediate tables that several jobs read, in folders of their own under the shared one."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files


def shared(spark: SparkSession) -> str:
    """What driver and executors share: spark.checkpoint.dir, or the warehouse where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession, hours: float = 24.0) -> list[str]:
    """Delete the folders of intermediate tables that nothing has changed for so long; those of running jobs must be younger."""
    old = [name for name, changed in files.folders(spark, shared(spark)) if re.fullmatch(r"[a-z_-]+-[0-9a-f]{32}", name) and changed < time.time() - 3600 * hours]
    for name in old:
        files.delete(spark, f"{shared(spark)}/{name}")
    return old


def settle(df: DataFrame) -> DataFrame:
    """Write to the folder that driver and executors share and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
