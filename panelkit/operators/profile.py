"""Dataset metadata and per-column profile."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from panelkit.operators.joins import join_small
from panelkit.operators.stats import border_sketch, quantile_columns, with_bin
from panelkit.spec import PanelSpec


def dataset_metadata(df: DataFrame, spec: PanelSpec, custom: dict | None = None) -> DataFrame:
    """One row: rows, columns, names, date range, entity count, types."""
    T, E = spec.time, spec.entity
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    aggs += [F.min(T).alias("date_start"), F.max(T).alias("date_end")] if T in df.columns else [
        F.lit(None).cast("date").alias("date_start"), F.lit(None).cast("date").alias("date_end")]
    aggs.append(F.count_distinct(E).cast("long").alias("locations") if E in df.columns else F.lit(0).cast("long").alias("locations"))
    out = df.agg(*aggs).withColumns({
        "total_columns": F.lit(len(df.columns)).cast("long"),
        "columns": F.lit(",".join(df.columns)),
        "data_types": F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)),
    })
    if custom:
        out = out.withColumn("custom", F.lit(json.dumps(custom, sort_keys=True)))
    return out


def metadata_document(df: DataFrame, spec: PanelSpec, custom: dict | None = None) -> DataFrame:
    """A24 as one nested row: counts, array of names, struct of the date range, map of types, custom map.

    Written by ``sinks.save_json`` it is one JSON object.
    """
    T, E = spec.time, spec.entity
    none = F.lit(None).cast("date")
    span = [F.min(T), F.max(T)] if T in df.columns else [none, none]
    locations = F.count_distinct(E) if E in df.columns else F.lit(0)
    texts = lambda d: F.create_map(*[F.lit(x) for kv in d for x in kv]) if d else F.create_map().cast("map<string,string>")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.struct(span[0].alias("start"), span[1].alias("end")).alias("date_range"),
        locations.cast("long").alias("locations"),
    ).select(
        "total_rows", F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "date_range", "locations",
        texts(df.dtypes).alias("data_types"),
        texts([(str(k), str(v)) for k, v in sorted((custom or {}).items())]).alias("custom"))


def _kind(dt) -> str | None:
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, (DateType, TimestampType, TimestampNTZType)):
        return "date"
    if isinstance(dt, StringType):
        return "string"
    return None


def column_profile(df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Per column count, unique, top, freq, mean, std, min, quartiles, max,
    missing count and missing % (2 dp).

    Numbers are profiled as doubles, dates as day numbers (days since
    1970-01-01; no std, as for date columns in the surveyed profile), strings
    get unique/top/freq (top = most frequent, smallest value on ties).
    Quartiles are exact and distributed (``quantile_columns``): rows x columns
    values are never shuffled.
    """
    skip = {spec.ord} if spec else set()
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields if f.name not in skip}
    kinds = {c: k for c, k in kinds.items() if k}

    def num(c):
        k = kinds[c]
        return F.unix_date(F.to_date(F.col(c))).cast("double") if k == "date" else F.col(c).cast("double")

    # One scan: the statistics and a border sketch of every number column, one row on the driver.
    base = []
    for c, k in kinds.items():
        x = num(c) if k != "string" else None
        base.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(k).alias("kind"),
            F.count(c).alias("count"),
            (F.avg(x) if x is not None else F.lit(None).cast("double")).alias("mean"),
            (F.stddev_samp(x) if k == "numeric" else F.lit(None).cast("double")).alias("std"),
            (F.min(x) if x is not None else F.lit(None).cast("double")).alias("min"),
            (F.max(x) if x is not None else F.lit(None).cast("double")).alias("max"),
            F.count_if(F.col(c).isNull()).alias("missing_count"),
            F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias("missing_percentage"),
        ))
    numc = [c for c, k in kinds.items() if k != "string"]
    sketches = [border_sketch(F.when(~F.isnan(num(c)), num(c))).alias(f"_b{i}") for i, c in enumerate(numc)]
    first = df.agg(F.array(*base).alias("_s"), *sketches).first()
    spark = df.sparkSession
    out = spark.createDataFrame(first["_s"], "column string, kind string, count long, mean double, std double, min double, "
                                "max double, missing_count long, missing_percentage double")
    if numc:
        # Values meet their bin in the scan; only counts per bin and the bins around the quartiles are shuffled.
        melted = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("_i"), num(c).alias("v")) for i, c in enumerate(numc)])).alias("m")).select("m.*")
        melted = with_bin(melted.where("v IS NOT NULL AND NOT isnan(v)"), "v", [first[f"_b{i}"] for i in range(len(numc))], "_i")
        qs = quantile_columns(melted, ["column"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rows=melted)
        out = join_small(out, qs, "column", "left")
    else:
        out = out.withColumns({q: F.lit(None).cast("double") for q in ("q25", "q50", "q75")})

    strc = [c for c, k in kinds.items() if k == "string"]
    if strc:
        melted = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in strc])).alias("m")).select("m.*")
        vc = melted.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("_c"))
        st = vc.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min_by("v", F.struct(-F.col("_c"), F.col("v"))).alias("top"),
            F.max("_c").alias("freq"),
        )
        out = join_small(out, st, "column", "left")
    else:
        out = out.withColumns({"unique": F.lit(None).cast("long"), "top": F.lit(None).cast("string"),
                               "freq": F.lit(None).cast("long")})
    return out.select("column", "kind", "count", "unique", "top", "freq", "mean", "std", "min",
                      "q25", "q50", "q75", "max", "missing_count", "missing_percentage")
