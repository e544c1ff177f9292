"""Helpers shared by the text operators: word rule, column guards, bounded collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so other columns cannot clash."""
    return df.select(*[df[src].alias(dst) for dst, src in columns.items()])


def text_key(text: Column) -> list[Column]:
    """96 bits that name a text (64 and 32, as longs); null and the empty text share a key."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.shiftrightunsigned(F.xxhash64(F.lit("second"), t, F.length(t)), 32).alias("k2")]


def collect_bounded(df: DataFrame, bound: int, what: str) -> list[Row]:
    """Rows of a table that must stay small, with the bound checked instead of assumed."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows; raise the documented bound or group the values")
    return rows


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5; a null id is held out, so nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
