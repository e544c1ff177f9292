"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelkit.functions.scalar import inf_to_null, parse_date
from panelkit.operators.aggregates import is_country
from panelkit.spec import AGGREGATE_NAMES, ESSENTIAL_COLUMNS, INTERMEDIATE_FEATURES, NULL_THRESHOLD, PanelSpec


def project(df: DataFrame, cols) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    return df.select(*[c for c in cols if c in df.columns])


def select_numeric(df: DataFrame, spec: PanelSpec, exclude=(), include_only=()) -> DataFrame:
    """Entity plus numeric columns, minus ``exclude``, restricted to ``include_only``."""
    cols = spec.numeric_columns(df, exclude)
    if include_only:
        cols = [c for c in cols if c in include_only]
    return df.select(spec.entity, *cols)


def drop_intermediate(df: DataFrame, names=None) -> DataFrame:
    """Drop the intermediate feature columns that exist; Catalyst then
    removes the windows that only fed them."""
    names = INTERMEDIATE_FEATURES if names is None else names
    return df.drop(*[c for c in names if c in df.columns])


def rename_labels(df: DataFrame, mapping: dict) -> DataFrame:
    """P5: rename by dictionary (missing names ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def countries_only(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with a group and an entity other than the world row."""
    return df.where(is_country(spec))


def not_aggregate(spec: PanelSpec, names=None) -> F.Column:
    names = AGGREGATE_NAMES if names is None else names
    return F.coalesce(~F.lower(F.col(spec.entity)).isin(*names), F.lit(True))


def exclude_aggregates(df: DataFrame, spec: PanelSpec, names=None) -> DataFrame:
    """Drop aggregate names, case-insensitive; a null entity is kept."""
    return df.where(not_aggregate(spec, names))


def entity_key(df: DataFrame, spec: PanelSpec) -> F.Column:
    """The lower-case entity: the stored key column where the panel has one (a predicate on it reaches the scan), else an expression."""
    return F.col(spec.ekey) if spec.ekey in df.columns else F.lower(F.col(spec.entity))


def entity_rows(df: DataFrame, spec: PanelSpec, names) -> DataFrame:
    """Rows whose lower-case entity is one of ``names``; the key column stays, so windows can follow."""
    k, names = entity_key(df, spec), [n.lower() for n in names]
    return df.where(k == F.lit(names[0]) if len(names) == 1 else k.isin(*names))


def entity_history(df: DataFrame, spec: PanelSpec, name: str) -> DataFrame:
    """P8 (+P20), X6: all rows of one entity, matched case-insensitively, with
    +-Inf/NaN turned into null."""
    return sanitize_output(entity_rows(df, spec, [name])).drop(spec.ekey)


def parse_entity_list(text: str) -> list[str]:
    """comma list -> trimmed, lower-case, blanks dropped; empty is an error."""
    toks = [t.strip().lower() for t in text.split(",") if t.strip()]
    if not toks:
        raise ValueError("entity list is empty")
    return toks


def entities_in(df: DataFrame, spec: PanelSpec, text: str) -> DataFrame:
    """Case-insensitive IN over a comma list."""
    return entity_rows(df, spec, parse_entity_list(text)).drop(spec.ekey)


def entity_eq(df: DataFrame, spec: PanelSpec, names) -> DataFrame:
    """P10: exact (case-sensitive) equality / IN."""
    names = [names] if isinstance(names, str) else list(names)
    return df.where(F.col(spec.entity).isin(*names))


def date_range(df: DataFrame, spec: PanelSpec, start=None, end=None) -> DataFrame:
    """Closed range, either bound optional (``YYYY-MM-DD``). On a stored
    date column both bounds reach the Parquet scan as pushed filters."""
    T = F.col(spec.time)
    cond = F.lit(True)
    if start:
        cond = cond & (T >= F.to_date(F.lit(start)))
    if end:
        cond = cond & (T <= F.to_date(F.lit(end)))
    return df.where(cond)


def drop_nulls(df: DataFrame, cols) -> DataFrame:
    """Drop a row if any listed column is null."""
    return df.dropna(subset=list(cols))


def positive_only(df: DataFrame, metric: str, fallback: bool = True) -> DataFrame:
    """Keep v > 0; with ``fallback`` the unfiltered rows are kept when
    nothing positive is left (histogram/box behaviour)."""
    if not fallback:
        return df.where(F.col(metric) > 0)
    from panelkit.operators.joins import join_one_row

    flag = df.agg(F.max(F.col(metric) > 0).alias("_anypos"))
    return join_one_row(df, flag).where((F.col(metric) > 0) | ~F.coalesce(F.col("_anypos"), F.lit(False))).drop("_anypos")


def parse_dates(df: DataFrame, spec: PanelSpec, fmt: str | None = None, keep_raw: str | None = None) -> DataFrame:
    """Text dates -> DateType, unparsable -> null."""
    T = spec.time
    d = df.withColumn(keep_raw, F.col(T)) if keep_raw else df
    return d.withColumn(T, parse_date(F.col(T), fmt))


def drop_bad_dates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Drop rows whose date is null (after parsing)."""
    return df.where(F.col(spec.time).isNotNull())


def bad_date_sample(raw: DataFrame, spec: PanelSpec, raw_col: str, n: int = 10) -> DataFrame:
    """P14 report: up to ``n`` distinct raw values that failed to parse (a sample by design)."""
    return raw.where(F.col(spec.time).isNull()).select(raw_col).distinct().orderBy(raw_col).limit(n)


def null_ratio_columns(df: DataFrame, threshold: float = NULL_THRESHOLD, essential=None) -> list[str]:
    """P17 pass 1: one aggregation of null shares, collected as a single row
    (one value per column)."""
    essential = ESSENTIAL_COLUMNS if essential is None else essential
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] is not None and row[c] > threshold and c not in essential]


def prune_null_columns(df: DataFrame, threshold: float = NULL_THRESHOLD, essential=None) -> DataFrame:
    """Drop columns whose null share exceeds ``threshold`` (two passes)."""
    return df.drop(*null_ratio_columns(df, threshold, essential))


def head_sample(df: DataFrame, spec: PanelSpec, n: int = 5) -> DataFrame:
    """First ``n`` rows in (entity, time) order."""
    return df.orderBy(spec.entity, spec.time, spec.ord).limit(n)


def sanitize_output(df: DataFrame) -> DataFrame:
    """P20: +-Inf and NaN -> null on floating columns."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: inf_to_null(c) for c in fl}) if fl else df
