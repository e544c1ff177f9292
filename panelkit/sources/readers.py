"""Scans (S1, S2, S6) with source-order ordinal and NaN -> null at load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType

from panelkit.functions.scalar import parse_date
from panelkit.operators.joins import join_small
from panelkit.session import cut_lineage
from panelkit.spec import PanelSpec


def number_rows(scan: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row in the source to a plain file scan, over any number of files and splits.

    A file block (path, first byte) is read by one task from its first row to
    its last, so within it the running id of that task numbers the rows. One
    pass counts the rows of each block; a running sum over the blocks, in the
    order of path and place, says how many rows come before it. The block table (a
    row a block) is stored and joined back, by broadcast if it is small enough.
    """
    raw = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(blocks.select("_file", "_block", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")))
    return join_small(raw, blocks, ["_file", "_block"], "left").withColumn(
        name, F.col("_id") + F.col("_shift")).drop("_file", "_block", "_id", "_shift")


def _finish(df: DataFrame, spec: PanelSpec, add_ord: bool, metrics_to_double: bool) -> DataFrame:
    """Dates parsed (bad -> null), metrics as double, NaN -> null, ``_ord`` added.

    ``_ord`` is the place of the row in the source: files in the order of their
    paths, rows as they stand in each file (``number_rows``).
    """
    if add_ord and spec.ord not in df.columns:
        df = number_rows(df, spec.ord)
    T = spec.time
    if T in df.columns:
        df = df.withColumn(T, parse_date(F.col(T).cast("string")))
    keys = set(spec.keys)
    conv = {}
    for f in df.schema.fields:
        if f.name in keys or not isinstance(f.dataType, NumericType):
            continue
        c = F.col(f.name).cast("double") if metrics_to_double else F.col(f.name)
        if metrics_to_double or isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        conv[f.name] = c
    if conv:
        df = df.withColumns(conv)
    if spec.ord in df.columns:
        df = df.withColumn(spec.ord, F.col(spec.ord).cast("long"))  # inference may give int
    return df


def scan_csv(spark: SparkSession, path: str, spec: PanelSpec, schema: StructType | str | None = None,
             add_ord: bool = True, metrics_to_double: bool = True) -> DataFrame:
    """CSV with header; an explicit schema where known, else the types are inferred by one pass over the text."""
    r = spark.read.option("header", True)
    if schema is None:
        schema = r.option("inferSchema", True).csv(path).schema  # once; later passes know the types
        r = spark.read.option("header", True)
    r = r.schema(schema)
    return _finish(r.csv(path), spec, add_ord, metrics_to_double)


def scan_json(spark: SparkSession, path: str, spec: PanelSpec, schema: StructType | str | None = None,
              add_ord: bool = True, metrics_to_double: bool = True) -> DataFrame:
    """Record-array / JSON-lines input to a typed frame with a date cast."""
    r = spark.read.option("multiLine", False)
    if schema is not None:
        r = r.schema(schema)
    return _finish(r.json(path), spec, add_ord, metrics_to_double)


def scan_parquet(spark: SparkSession, path: str, spec: PanelSpec, add_ord: bool = True,
                 metrics_to_double: bool = False) -> DataFrame:
    return _finish(spark.read.parquet(path), spec, add_ord, metrics_to_double)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """S3: raise on empty input (one-row probe, used at entry points only)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
