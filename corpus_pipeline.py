"""The corpus pipeline: documents to a training mix, each stage one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm.common import table
from panelkit.llm.stages import STAGES
from panelkit.session import scratch_path

ORACLE_SQL = None  # classifier, alignment and seeded draws are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
