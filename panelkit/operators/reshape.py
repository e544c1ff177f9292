"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def unpivot_metrics(df: DataFrame, ids, metrics, var: str = "metric", val: str = "value") -> DataFrame:
    """U2 (long form): one row per (ids, metric)."""
    return df.unpivot(list(ids), list(metrics), var, val)


def pivot_metric_by_entity(long: DataFrame, entity: str, value: str, entities=None,
                           metric: str = "metric") -> DataFrame:
    """U2 (wide form): metric x entity matrix; pass ``entities`` to skip the
    extra job that collects the distinct pivot values."""
    g = long.groupBy(metric)
    g = g.pivot(entity, list(entities)) if entities else g.pivot(entity)
    return g.agg(F.first(value))


def nested_series(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Entity -> [{date, value}] sorted by date, one row per entity."""
    pts = F.sort_array(F.collect_list(F.struct(F.col(time).alias("date"), F.col(value).alias("value"))))
    return df.groupBy(entity).agg(pts.alias("series"))


def records_json(df: DataFrame) -> DataFrame:
    """U4: each row as one JSON object (null fields kept as null)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                               {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}).alias("record"))
