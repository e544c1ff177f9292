"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``. Each is one operator
with the parameters of its query, and its decisions take effect. Null, empty
and very long texts, repeated rows, ties and empty tables are treated as the
operator's docstring says; extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import crf, decontaminate, hamming, mixing, suffixes
from panelkit.llm.common import table

def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line classifier does not reject."""
    field = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.quality(docs, field, carry=True).where("predicted = 1").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id; rows that repeat an id or have none are grouped by their texts."""
    return hamming.one_of_each_group(docs, shingle=4, bits=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of strings that start in two places; n_chars follows the text."""
    return suffixes.suffix_dedup_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item was found."""
    return decontaminate.without_matches(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix draws, with size, source_size, target, taken and draws (shard, pass, words)."""
    return mixing.mixed_texts(docs, weights=[5, 2, 1])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]
