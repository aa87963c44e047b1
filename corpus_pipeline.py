"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept. All but the last
return the columns of ``documents``: mixing repeats a document for each pass over it and cuts the last one of a source where
the mix ends, in training order; the last stage writes token-ID files and returns what they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, mixing, near_dedup, queries, token_files, toxicity
from tidewater.llm._shared import documents, shared_dir


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; the model is fitted on labelled documents of the input."""
    model = toxicity.fit_toxicity(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where(~F.col("toxic")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id."""
    return near_dedup.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each pass over a document, its text cut to the words taken."""
    return mixing.take_mix(docs, queries.MIX_SCHEDULES).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files in ascending id order, read back."""
    return token_files.token_digest(spark, docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("token_ids", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: Learned models and hashes of texts decide the rows; SQL cannot express them.
ORACLE_SQL = None
