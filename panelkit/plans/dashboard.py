"""Dashboard analytics X8-X13 over the latest cross-section and entity histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators import stats as S
from panelkit.operators import windows as W
from panelkit.operators.aggregates import (
    KPI_METRICS, global_sums, group_rollup_share, population_parts, world_population_columns,
)
from panelkit.operators.filters import (
    date_range, drop_nulls, entity_eq, entity_rows, exclude_aggregates, head_sample, positive_only, project,
)
from panelkit.operators.joins import join_one_row, metric_label_join
from panelkit.spec import CONTEXT_COLUMNS, FLOW_METRICS, HISTOGRAM_BINS, INTERMEDIATE_FEATURES, TRIM_FACTOR, PanelSpec


def map_feed(latest: DataFrame, spec: PanelSpec, metric: str) -> DataFrame:
    """Code, entity and metric of non-aggregate entities (map input)."""
    return project(exclude_aggregates(latest, spec), [spec.code, spec.entity, metric])


def group_overview(latest: DataFrame, spec: PanelSpec, metric: str) -> DataFrame:
    """Per-group totals and shares over non-aggregate entities."""
    return group_rollup_share(exclude_aggregates(latest, spec), spec, metric)


def is_flow(metric: str) -> bool:
    return metric in FLOW_METRICS or metric in INTERMEDIATE_FEATURES


def period_analysis(df: DataFrame, spec: PanelSpec, metrics, start=None, end=None, window: int = 7) -> DataFrame:
    """X9 series: per entity in the closed range the metrics, the centred
    ``window``-row mean of the flow metrics, newest rows first (O3)."""
    metrics = [m for m in ([metrics] if isinstance(metrics, str) else metrics) if m in df.columns]
    d = date_range(df, spec, start, end).select(spec.entity, spec.time, spec.ord, *metrics)
    d = W.centered_average(d, spec, [m for m in metrics if is_flow(m)], window)
    return d.drop(spec.ord).orderBy(F.col(spec.entity), F.col(spec.time).desc())


def period_view(df: DataFrame, spec: PanelSpec, metrics, dictionary: DataFrame, start=None, end=None, entities=None,
                context=tuple(CONTEXT_COLUMNS)) -> DataFrame:
    """X9 summary: one row per entity and metric, from one conditional aggregate over one scan.

    Flow metrics have total, mean and peak of the closed range, stock metrics
    the recent and initial value and the increment; the others are null, as
    they are where the range holds no value. Every row has the attributes of
    the entity's last history row, inside the range or not. ``dictionary``
    (metric, label) names the metrics (J3).
    """
    metrics = [m for m in metrics if m in df.columns]
    context = [c for c in context if c in df.columns]
    d = entity_rows(df, spec, entities) if entities else df
    T, at = F.col(spec.time), F.struct(F.col(spec.time), F.col(spec.ord))
    inside = F.lit(True)
    if start:
        inside = inside & (T >= F.to_date(F.lit(start)))
    if end:
        inside = inside & (T <= F.to_date(F.lit(end)))
    none = F.lit(None).cast("double")

    def summary(m: str) -> Column:
        v = F.when(inside, F.col(m)).cast("double")
        if is_flow(m):
            parts = [F.sum(v), F.avg(v), F.max(v), none, none]
        else:
            order = F.when(v.isNotNull(), at)
            parts = [none, none, none, F.max_by(v, order), F.min_by(v, order)]
        names = ["period_total", "daily_mean", "peak", "recent_value", "initial_value"]
        return F.struct(F.lit(m).alias("metric"), F.lit("flow" if is_flow(m) else "stock").alias("kind"),
                        *[p.alias(n) for p, n in zip(parts, names)])

    last = F.max_by(F.struct(*[F.col(c) for c in context]), at) if context else F.struct()
    one = d.where(F.col(spec.entity).isNotNull()).groupBy(spec.entity).agg(
        F.count_if(inside).alias("_rows"), last.alias("_c"), F.array(*[summary(m) for m in metrics]).alias("_m"))
    rows = one.where("_rows > 0").select(spec.entity, *[F.col(f"_c.{c}").alias(c) for c in context], F.inline("_m"))
    rows = rows.withColumn("increment", F.col("recent_value") - F.col("initial_value"))
    return metric_label_join(rows, dictionary)


def compare_bar(latest: DataFrame, spec: PanelSpec, entities, metric: str) -> DataFrame:
    """Chosen entities sorted by the metric, largest first, nulls last."""
    d = entity_eq(exclude_aggregates(latest, spec), spec, entities)
    return d.select(spec.entity, metric).orderBy(F.col(metric).desc_nulls_last(), spec.entity)


def compare_scores(latest: DataFrame, spec: PanelSpec, entities, metrics) -> DataFrame:
    """Min-max scores of the chosen entities (long form: entity, metric, value, score)."""
    d = entity_eq(exclude_aggregates(latest, spec), spec, entities)
    return S.minmax_score(d, spec.entity, metrics)


def factor_rows(latest: DataFrame, spec: PanelSpec, metric: str, group_value: str | None = None,
                include_outliers: bool = False) -> DataFrame:
    """X11 input: non-aggregate rows (one group optionally), metric not null,
    IQR-trimmed unless outliers are included."""
    d = exclude_aggregates(latest, spec)
    if group_value is not None:
        d = d.where(F.col(spec.group) == group_value)
    d = d.select(spec.entity, spec.group, metric).dropna(subset=[metric])
    return d if include_outliers else S.iqr_trim(d, metric)


def factor_summary(latest: DataFrame, spec: PanelSpec, metric: str, log_scale: bool = False) -> DataFrame:
    """X11: descriptive statistics plus the entities nearest to mean and median."""
    rows = factor_rows(latest, spec, metric)
    search = positive_only(rows, metric, fallback=True) if log_scale else rows
    desc = S.describe_metric(rows, metric)
    near = S.nearest_to_center(rows, search, spec.entity, metric).drop("mean", "median")
    return join_one_row(desc, near)


STUDY = "section string, item string, label string, value double, lower double, upper double, count long"


def factor_study(latest: DataFrame, spec: PanelSpec, metric: str, log_scale: bool = False, include_outliers: bool = False,
                 group_value: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """X11 in one result: (section, item, label, value, lower, upper, count).

    summary          mean, median, std, n, q1, q3 of the trimmed rows
    representative   entity nearest to the mean and to the median (label, its value)
    histogram        equal bins between the extremes (item = bin number)
    box              per group (label) quartiles, fences and whiskers; count = rows
    outlier          points outside the fences of their group (item = group, label = entity)

    The rows with a value are stored once with their bins, and all sections
    read that table: the trim bounds, the quartiles of what is left (the same
    bins hold for any part of the rows) and the groups' fences. With
    ``log_scale`` the drawn rows (all sections but the summary) are the positive ones, or all if none is.
    """
    spark, E, G = latest.sparkSession, spec.entity, spec.group
    d = exclude_aggregates(latest, spec)
    if group_value is not None:
        d = d.where(F.col(G) == group_value)
    rows = S.binned(d, metric, [E, G])
    v = F.col(metric)
    if not include_outliers:
        q, n = S.quantile_row(rows, metric, {"q1": 0.25, "q3": 0.75})
        if n > 1:
            lo, hi = S.trim_bounds(q["q1"], q["q3"], TRIM_FACTOR)
            rows = rows.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
    quartiles, n = S.quantile_row(rows, metric, S.QUARTILES)
    if not n:
        return spark.createDataFrame([], STUDY)
    positive = F.when(v > 0, v)
    one = rows.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                   F.min(positive).alias("plo"), F.max(positive).alias("phi")).first()
    drawn, lo, hi = rows, float(one["lo"]), float(one["hi"])
    if log_scale and one["phi"] is not None:
        drawn, lo, hi = rows.where(v > 0), float(one["plo"]), float(one["phi"])
    shown = {"mean": one["mean"], "median": quartiles["median"], "std": one["std"], "n": float(n), "q1": quartiles["q1"], "q3": quartiles["q3"]}
    summary = spark.createDataFrame([("summary", k, None, None if x is None else float(x), None, None, None) for k, x in shown.items()], STUDY)

    def study(df, section, item, label, value=None, lower=None, upper=None, count=None):
        as_is = lambda c, t: (F.lit(None) if c is None else c).cast(t)
        return df.select(F.lit(section).alias("section"), as_is(item, "string").alias("item"), as_is(label, "string").alias("label"),
                         as_is(value, "double").alias("value"), as_is(lower, "double").alias("lower"),
                         as_is(upper, "double").alias("upper"), as_is(count, "long").alias("count"))

    near = [F.struct(F.lit(f"nearest_to_{k}").alias("item"),
                     F.min_by(F.struct(F.col(E).alias("e"), v.cast("double").alias("v")), F.struct(F.abs(v - F.lit(float(shown[k]))), F.col(E))).alias("r"))
            for k in ("mean", "median")]
    near = drawn.agg(F.array(*near).alias("a")).select(F.inline("a"))
    width = (hi - lo) / bins
    number = F.least(F.floor((v - lo) / (hi - lo) * bins) + 1, F.lit(bins)) if hi > lo else F.lit(1)
    hist = drawn.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    fences = S.box_fences(drawn.where(F.col(G).isNotNull()), metric, G)
    joined, inside = S.beside_fences(drawn, fences, metric, G)
    first = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    box = joined.groupBy(G).agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in first],
                                F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"))
    box = box.unpivot([G, "c"], [*first, "whisker_low", "whisker_high"], "item", "value")
    b = F.col("bin")
    parts = [
        study(near, "representative", F.col("item"), F.col("r.e"), F.col("r.v")),
        study(hist, "histogram", b, None, None, lo + (b - 1) * width, lo + b * width, F.col("c")),
        study(box, "box", F.col("item"), F.col(G), F.col("value"), count=F.col("c")),
        study(joined.where(~inside), "outlier", F.col(G), F.col(E), v, F.col("lower_fence"), F.col("upper_fence")),
    ]
    out = summary
    for p in parts:
        out = out.unionByName(p)
    return out


def factor_correlations(latest: DataFrame, spec: PanelSpec, outcome: str, factors, k: int = 15) -> DataFrame:
    """X11: top-k Spearman correlations with the outcome."""
    d = exclude_aggregates(latest, spec)
    return S.topk_correlation(S.spearman(d, spec.entity, outcome, factors), k)


def factor_scatter_fit(latest: DataFrame, spec: PanelSpec, x: str, y: str, include_outliers: bool = False) -> DataFrame:
    """X11: OLS line per group after the sequential x/y trim."""
    d = exclude_aggregates(latest, spec).select(spec.entity, spec.group, x, y)
    d = drop_nulls(d, [x, y]) if include_outliers else S.iqr_trim_xy(d, x, y)
    return S.ols_by_group(d, x, y, spec.group)


def kpi_strip(latest: DataFrame, spec: PanelSpec) -> DataFrame:
    """Global sums, world population (with fallback), entity count, last date, in one aggregate."""
    sums = global_sums(latest, KPI_METRICS)
    k = latest.agg(*sums, *population_parts(spec), F.max(spec.time).alias("last_update"))
    return k.select(*[m for m in KPI_METRICS if m in latest.columns], *world_population_columns(), "entities", "last_update")


def audit_samples(stages: dict, spec: PanelSpec, cols, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each stage in (entity, time) order; a column that a stage has dropped is null there."""
    order = Window.orderBy(spec.entity, spec.time, spec.ord)
    out = None
    for name, df in stages.items():
        kept = [c for c in cols if c in df.columns]
        head = head_sample(df.select(*dict.fromkeys([spec.entity, spec.time, spec.ord, *kept])), spec, n)
        one = head.select(F.lit(name).alias("stage"), F.row_number().over(order).alias("place"), spec.entity, spec.time, *kept)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def audit_reports(stages: dict) -> DataFrame:
    """The reports of the stages as (stage, measure, value); each holds what was observed while the stage was written."""
    out = None
    for name, result in stages.items():
        report = result.report()
        numbers = [c for c, t in report.dtypes if t == "bigint"]
        one = report.select(*numbers).unpivot([], numbers, "measure", "value").withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("stage", "measure", "value")


def pipeline_audit(stages: dict) -> DataFrame:
    """Null counts per column and row counts, one aggregate for each named stage."""
    out = None
    for name, df in stages.items():
        per = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns])
        one = df.agg(F.count(F.lit(1)).alias("rows"), per.alias("_n")).select("rows", F.inline("_n"))
        nc = one.withColumns({"stage": F.lit(name), "columns": F.lit(len(df.columns)).cast("long")})
        out = nc if out is None else out.unionByName(nc)
    return out.select("stage", "column", "nulls", "rows", "columns")
