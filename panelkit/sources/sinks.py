"""Sinks (S7-S12)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.profile import column_profile, metadata_document
from panelkit.spec import PanelSpec

PART_COL = "_part"
FORMATS = ("csv", "parquet", "json")


def _stamp(prefix: str) -> str:
    return f"{prefix}_{datetime.now().strftime('%Y%m%d_%H%M%S')}"


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header (one folder of part files)."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Snappy Parquet."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines with ISO dates."""
    df.write.mode(mode).option("dateFormat", "yyyy-MM-dd").json(path)
    return path


def partition_value(entity_col: str) -> F.Column:
    """space and '/' -> '_'."""
    return F.translate(F.col(entity_col), " /", "__")


def save_by_entity(df: DataFrame, spec: PanelSpec, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """One folder per entity in a single pass (``partitionBy``) instead of
    one filtered scan per entity. Rows are clustered by the partition value
    first, so that each task writes few files; the rebalance splits an entity
    that is larger than a partition should be among several tasks."""
    if spec.entity not in df.columns:
        raise ValueError(f"column {spec.entity!r} is needed to write by entity")
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(FORMATS)}")
    d = df.withColumn(PART_COL, partition_value(spec.entity)).hint("rebalance", PART_COL)
    w = d.write.mode(mode).partitionBy(PART_COL)
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.option("dateFormat", "yyyy-MM-dd").json(path)
    return path


def save_all_formats(df: DataFrame, spec: PanelSpec, base_dir: str, base_name: str | None = None,
                     custom: dict | None = None) -> dict:
    """CSV, Parquet, JSON, metadata and profile; the frame is persisted once
    so the five writes share one computation."""
    name = base_name or _stamp("panel")
    d = df.persist()
    try:
        out = {
            "csv": save_csv(d, f"{base_dir}/{name}.csv"),
            "parquet": save_parquet(d, f"{base_dir}/{name}.parquet"),
            "json": save_json(d, f"{base_dir}/{name}.json"),
        }
        out["metadata"] = save_json(metadata_document(d, spec, custom), f"{base_dir}/{name}_metadata.json")
        out["statistics"] = save_csv(column_profile(d, spec), f"{base_dir}/{name}_statistics.csv")
    finally:
        d.unpersist()
    return out


def materialize(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Write the processed panel (Parquet or a catalog table) and return a
    scan of it, so later queries start from the stored result."""
    spark = df.sparkSession
    if table:
        df.write.mode("overwrite").option("path", path).saveAsTable(table)
        return spark.table(table)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def store_keyed(df: DataFrame, spec: PanelSpec, path: str) -> DataFrame:
    """The panel with a stored lower-case entity (``spec.ekey``), sorted by it, with a bloom filter on it.

    Case-insensitive lookups then compare a stored column, so the scan skips
    files, row groups and pages by their statistics. The sort splits the rows
    at sampled borders of (key, time, order), so a large entity takes several files.
    """
    d = df.withColumn(spec.ekey, F.lower(F.col(spec.entity)))
    order = [c for c in (spec.ekey, spec.time, spec.ord) if c in d.columns]
    d.orderBy(*order).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{spec.ekey}", "true").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_bucketed(df: DataFrame, spec: PanelSpec, table: str, path: str, buckets: int = 16) -> DataFrame:
    """The panel as a catalog table, bucketed by entity and sorted by (entity, time) in each bucket.

    Per-entity windows and joins on the entity then need no exchange. Rows are
    dealt to the buckets by the same hash before they are written, so each
    bucket is one file.
    """
    E, order = spec.entity, [c for c in (spec.entity, spec.time, spec.ord) if c in df.columns]
    writer = df.repartition(buckets, F.col(E)).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, E).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)
