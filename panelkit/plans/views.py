"""Result views X5-X7: compare series, entity history, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import inf_to_null
from panelkit.operators.aggregates import latest_per_entity
from panelkit.operators.filters import date_range, entity_key, entity_rows, parse_entity_list, sanitize_output
from panelkit.operators.joins import join_small
from panelkit.operators.reshape import nested_series
from panelkit.spec import PanelSpec


def compare_timeseries(df: DataFrame, spec: PanelSpec, entities: str, metric: str,
                       start=None, end=None) -> DataFrame:
    """X5 (flat form): (entity, date, value) for every requested entity.

    Requested names are matched case-insensitively; a matched name is shown
    as its first spelling in (time, source) order, an unmatched one as
    requested with a single null point (the nested form's empty list).
    """
    E, T = spec.entity, spec.time
    if metric not in df.columns:
        raise ValueError(f"metric '{metric}' not found")
    raw = [t.strip() for t in entities.split(",") if t.strip()]
    toks = parse_entity_list(entities)
    seen, req = set(), []
    for r, t in zip(raw, toks):
        if t not in seen:
            seen.add(t)
            req.append((t, r))
    spark = df.sparkSession
    request = spark.createDataFrame(req, "_k string, _raw string")
    d = date_range(entity_rows(df, spec, toks), spec, start, end).select(
        entity_key(df, spec).alias("_k"), E, T, spec.ord, inf_to_null(metric).alias("value"))
    names = d.groupBy("_k").agg(F.min_by(E, F.struct(T, spec.ord)).alias("_name"))
    pts = d.join(names, "_k", "inner").select("_k", "_name", F.col(T).alias("date"), "value")
    j = join_small(pts, request, "_k", "right")
    return j.select(F.coalesce(F.col("_name"), F.col("_raw")).alias("entity"), "date", "value")


def compare_timeseries_nested(df: DataFrame, spec: PanelSpec, entities: str, metric: str,
                              start=None, end=None) -> DataFrame:
    """X5 + U3: entity -> [{date, value}] (empty list for unmatched names)."""
    flat = compare_timeseries(df, spec, entities, metric, start, end)
    n = nested_series(flat.where(F.col("date").isNotNull()), "entity", "date", "value")
    ents = flat.select("entity").distinct()
    return ents.join(n, "entity", "left").select(
        "entity", F.coalesce(F.col("series"), F.array().cast(n.schema["series"].dataType)).alias("series"))


def latest(df: DataFrame, spec: PanelSpec, entities: str | None = None) -> DataFrame:
    """Latest row per entity, optionally for a comma list, sanitised; an empty list text filters nothing."""
    d = entity_rows(df, spec, parse_entity_list(entities)) if entities else df
    return sanitize_output(latest_per_entity(d, spec)).drop(spec.ekey)
