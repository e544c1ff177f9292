"""Aggregations (A1-A17): rollups, latest rows, de-duplication, KPIs.

Every "pick one row per key" operator is an aggregate (``max_by`` over a
struct of the row) rather than a window: the partial aggregation collapses a
hot key inside each map task before the shuffle, so a key that holds a third
of all rows still moves one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.joins import join_one_row
from panelkit.session import cut_lineage
from panelkit.spec import (
    AGGREGATE_NAMES, WORLD_CODE, WORLD_ENTITY, WORLD_GROUP, WORLD_SUM_COLUMNS,
    WORLD_WEIGHTED_COLUMNS, PanelSpec,
)


def _pick(df: DataFrame, keys, order: F.Column, how: str = "max") -> DataFrame:
    """One whole row per key: the row with the largest (or smallest) ``order``."""
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    f = F.max_by if how == "max" else F.min_by
    return df.groupBy(*keys).agg(f(row, order).alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in cols])


def latest_per_entity(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The row with the latest date per entity; first row in source order on ties."""
    E, T, O = spec.entity, spec.time, spec.ord
    d = df.where(F.col(E).isNotNull() & F.col(T).isNotNull())
    return _pick(d, [E], F.struct(F.col(T), -F.col(O)))


def last_per_entity(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A2: the last record per entity in source order (not the latest date)."""
    d = df.where(F.col(spec.entity).isNotNull())
    return _pick(d, [spec.entity], F.col(spec.ord))


def dedupe_last(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per (entity, time), the last in source order; null keys form a group."""
    return _pick(df, [spec.entity, spec.time], F.col(spec.ord))


def dedupe_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A7 (no key columns): full-row duplicates removed, first occurrence kept."""
    others = [c for c in df.columns if c != spec.ord]
    if spec.ord not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*others).agg(F.min(spec.ord).alias(spec.ord)).select(*df.columns)


def is_country(spec: PanelSpec) -> F.Column:
    """A group is set and the entity is not the world row (null entity passes)."""
    return F.col(spec.group).isNotNull() & ~F.col(spec.entity).eqNullSafe(F.lit(WORLD_ENTITY))


def world_sum_by_date(df: DataFrame, spec: PanelSpec, cols=None) -> DataFrame:
    """A1: per date sums over countries; an all-null sum is 0; null dates dropped."""
    cols = [c for c in (WORLD_SUM_COLUMNS if cols is None else cols) if c in df.columns]
    T = spec.time
    c = df.where(is_country(spec) & F.col(T).isNotNull())
    return c.groupBy(T).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(x) for x in cols])


def weighted_columns(columns, weighted, weight: str, nonnull_only: bool = False) -> list[F.Column]:
    """A3 + A4 as aggregates over one row a country: the total weight and the weighted means.

    A null statistic adds 0 to the numerator. By default its weight stays in
    the denominator (Q3); ``nonnull_only`` leaves it out. The mean is null
    when the denominator is not above 0.
    """
    total = F.coalesce(F.sum(weight), F.lit(0)).cast("double")
    out = [total.alias(weight)]
    for c in columns if weighted is None else weighted:
        if c in columns:
            below = F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col(weight))), F.lit(0)).cast("double") if nonnull_only else total
            out.append(F.when(below > 0, F.try_divide(F.coalesce(F.sum(F.col(c) * F.col(weight)), F.lit(0.0)), below)).alias(c))
    return out


def world_statics(df: DataFrame, spec: PanelSpec, weighted=None, weight_nonnull_only: bool = False) -> DataFrame:
    """A3 + A4: one row with the total weight over the last record per country and
    the weight-averaged statics (``weighted_columns``)."""
    W = spec.weight
    weighted = [c for c in (WORLD_WEIGHTED_COLUMNS if weighted is None else weighted) if c in df.columns]
    last = df.where(is_country(spec) & F.col(spec.entity).isNotNull()).groupBy(spec.entity).agg(
        *[F.max_by(c, spec.ord).alias(c) for c in [W, *weighted]])
    return last.agg(*weighted_columns(weighted, None, W, weight_nonnull_only))


def rollup_parts(df: DataFrame, spec: PanelSpec, sum_cols, weighted) -> DataFrame:
    """A1-A4 from one scan: each country row counts in two grouping sets, its date and its entity.

    ``_set`` 0 has the sums of a date (``_t``), ``_set`` 1 the statics of the
    last record of an entity (``_e``). All buffers are numbers, so both halves
    of the aggregate are hash aggregates. The result has a row a date and a row an entity.
    """
    E, T, O, W = spec.entity, spec.time, spec.ord, spec.weight
    statics = [W, *weighted] if W in df.columns else []
    d = df.where(is_country(spec)).select(E, T, O, *dict.fromkeys([*sum_cols, *statics]))
    tagged = d.withColumn("_set", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("_set") == 1) | F.col(T).isNotNull())
    by_date, by_entity = F.col("_set") == 0, F.col("_set") == 1
    return tagged.groupBy("_set", F.when(by_date, F.col(T)).alias("_t"), F.when(by_entity, F.col(E)).alias("_e")).agg(
        *[F.sum(F.when(by_date, F.col(c))).alias(f"_s_{c}") for c in sum_cols],
        *[F.max_by(c, F.when(by_entity, F.col(O))).alias(f"_l_{c}") for c in statics])


def world_rollup(df: DataFrame, spec: PanelSpec, sum_cols=None, weighted=None, weight_nonnull_only: bool = False) -> DataFrame:
    """A5: countries plus a recomputed world row per date.

    Source aggregates (null group, or an existing world row) are dropped.
    If there is no country row the input is returned unchanged. The aggregates
    are taken in one scan and stored (a row a date and a row an entity); the
    returned plan scans the source once more, for the country rows.
    """
    E, T, G, C, O, W = spec.entity, spec.time, spec.group, spec.code, spec.ord, spec.weight
    sum_cols = [c for c in (WORLD_SUM_COLUMNS if sum_cols is None else sum_cols) if c in df.columns]
    weighted = [c for c in (WORLD_WEIGHTED_COLUMNS if weighted is None else weighted) if c in df.columns]
    parts = cut_lineage(rollup_parts(df, spec, sum_cols, weighted))
    if parts.isEmpty():
        return df
    world = parts.where("_set = 0").select(F.col("_t").alias(T), *[
        F.coalesce(F.col(f"_s_{c}"), F.lit(0)).cast("double").alias(c) for c in sum_cols])
    if W in df.columns:
        last = parts.where("_set = 1 AND _e IS NOT NULL").select(*[F.col(f"_l_{c}").alias(c) for c in [W, *weighted]])
        world = join_one_row(world, last.agg(*weighted_columns(weighted, None, W, weight_nonnull_only)))
    world = world.withColumns({
        E: F.lit(WORLD_ENTITY), C: F.lit(WORLD_CODE), G: F.lit(WORLD_GROUP), O: F.lit(0).cast("long")})
    world = world.select(*[F.col(c).cast(df.schema[c].dataType) if c in df.columns else F.col(c)
                           for c in world.columns])
    return df.where(is_country(spec)).unionByName(world, allowMissingColumns=True)


def entity_list(df: DataFrame, spec: PanelSpec, col: str | None = None) -> DataFrame:
    """Sorted distinct non-null entities (or groups)."""
    c = col or spec.entity
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def entity_selector(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A8 variant: title-cased aggregate names removed, World first."""
    E = spec.entity
    titled = [n.title() for n in AGGREGATE_NAMES]
    d = entity_list(df, spec).where(~F.col(E).isin(titled))
    world = df.sparkSession.createDataFrame([(WORLD_ENTITY,)], f"{E} string")
    return d.unionByName(world).distinct().orderBy((F.col(E) != WORLD_ENTITY), E)


def entity_count(df: DataFrame, spec: PanelSpec, approx: bool = False) -> DataFrame:
    """Distinct entity count."""
    E = spec.entity
    f = F.approx_count_distinct(E) if approx else F.count_distinct(E)
    return df.agg(f.cast("long").alias("entities"))


def load_stats(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows and distinct entities."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(spec.entity).cast("long").alias("entities"))


def date_bounds(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A10: first and last date."""
    T = spec.time
    return df.agg(F.min(T).alias("min_date"), F.max(T).alias("max_date"))


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Null count per column, one pass, long form (column, nulls)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


def group_rollup_share(df: DataFrame, spec: PanelSpec, metric: str) -> DataFrame:
    """Per-group sum (null groups and sums <= 0 dropped) and its share of the total."""
    G = spec.group
    g = df.where(F.col(G).isNotNull()).groupBy(G).agg(
        F.coalesce(F.sum(metric), F.lit(0)).cast("double").alias(metric)).where(F.col(metric) > 0)
    tot = g.agg(F.sum(metric).alias("_total"))
    return join_one_row(g, tot).withColumn("share", F.col(metric) / F.col("_total")).drop("_total")


def period_flow_kpis(df: DataFrame, spec: PanelSpec, metric: str, start=None, end=None) -> DataFrame:
    """Sum, mean and max of a flow metric per entity in a closed date range
    (null when the range holds no value)."""
    from panelkit.operators.filters import date_range

    d = date_range(df, spec, start, end)
    has = F.count(metric) > 0
    return d.groupBy(spec.entity).agg(
        F.when(has, F.sum(metric)).alias("period_total"),
        F.avg(metric).alias("daily_mean"),
        F.max(metric).alias("peak"),
    )


def period_stock_kpis(df: DataFrame, spec: PanelSpec, metric: str, start=None, end=None) -> DataFrame:
    """Last and first non-null value in the range and the increment."""
    from panelkit.operators.filters import date_range

    d = date_range(df, spec, start, end)
    v = F.col(metric)
    order = F.when(v.isNotNull(), F.struct(F.col(spec.time), F.col(spec.ord)))
    return d.groupBy(spec.entity).agg(
        F.max_by(v, order).alias("recent_value"),
        F.min_by(v, order).alias("initial_value"),
    ).withColumn("increment", F.col("recent_value") - F.col("initial_value"))


KPI_METRICS = ("total_cases", "new_cases", "total_deaths", "new_deaths")


def global_sums(latest: DataFrame, metrics=KPI_METRICS) -> list[F.Column]:
    """The sums of A15 as aggregate columns."""
    return [F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(m) for m in metrics if m in latest.columns]


def global_kpis(latest: DataFrame, spec: PanelSpec, exclude_aggregates: bool = False, metrics=KPI_METRICS) -> DataFrame:
    """Sums over all latest rows (the world row included unless excluded)."""
    from panelkit.operators.filters import exclude_aggregates as excl

    d = excl(latest, spec) if exclude_aggregates else latest
    return d.agg(*global_sums(d, metrics))


def population_parts(spec: PanelSpec) -> list[F.Column]:
    """Aggregates behind A16: world rows, their weight, the sum and number of the other entities."""
    from panelkit.operators.filters import not_aggregate

    E, W = spec.entity, spec.weight
    is_w, na = F.lower(F.col(E)) == F.lit("world"), not_aggregate(spec)
    return [
        F.count_if(is_w).alias("_nw"),
        F.min_by(F.col(W), F.when(is_w, F.struct(F.col(E), F.col(spec.ord)))).alias("_wp"),
        F.coalesce(F.sum(F.when(na, F.col(W))), F.lit(0)).cast("double").alias("_sp"),
        F.count_distinct(F.when(na, F.col(E))).cast("long").alias("entities"),
    ]


def world_population_columns() -> list[F.Column]:
    has = F.col("_nw") > 0
    return [F.when(has, F.col("_wp")).otherwise(F.col("_sp")).cast("double").alias("world_population"),
            F.when(has, F.lit("world_row")).otherwise(F.lit("sum_of_countries")).alias("population_source")]


def world_pop_fallback(latest: DataFrame, spec: PanelSpec) -> DataFrame:
    """The world row's weight if such a row exists (even if null), else
    the sum over non-aggregate rows. Also the non-aggregate entity count."""
    return latest.agg(*population_parts(spec)).select(*world_population_columns(), "entities")


def entity_context(df: DataFrame, spec: PanelSpec,
                   cols=("population", "gdp_per_capita", "median_age", "life_expectancy")) -> DataFrame:
    """Static attributes of each entity's last history row."""
    cols = [c for c in cols if c in df.columns]
    E, T, O = spec.entity, spec.time, spec.ord
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(T), F.col(O)))
    return df.where(F.col(E).isNotNull()).groupBy(E).agg(last.alias("_r")).select(
        E, *[F.col(f"_r.{c}").alias(c) for c in cols])
