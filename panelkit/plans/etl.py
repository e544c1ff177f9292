"""Composite pipelines X1-X4: clean, impute, features, full ETL, and their reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelkit.functions.scalar import clamp_negative, inf_to_null, non_negative_name, safe_div
from panelkit.operators import windows as W
from panelkit.operators.aggregates import dedupe_last, dedupe_rows, world_rollup
from panelkit.operators.filters import drop_intermediate, null_ratio_columns
from panelkit.session import cut_lineage
from panelkit.spec import (
    ESSENTIAL_COLUMNS, IQR_CAP_FACTOR, NON_NEGATIVE_KEYWORDS, NULL_THRESHOLD, PER_CAPITA, RATES, PanelSpec,
)

FLAG = "_out_"


def _write_observed(df: DataFrame, drop, **metrics) -> tuple[DataFrame, dict]:
    """Store a result and measure it in the same job: the stored rows without ``drop`` and the metrics."""
    seen = Observation()
    stored = cut_lineage(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).drop(*drop))
    return stored, seen.get


@dataclass
class CleanResult:
    df: DataFrame
    dropped_columns: list[str]
    duplicates: int | None
    flagged: DataFrame
    outliers: int | None = None

    def stored(self) -> DataFrame:
        """The cleaned panel, written once; the capped values are counted by the job that writes it."""
        if self.outliers is None:
            flags = [c for c in self.flagged.columns if c.startswith(FLAG)]
            total = sum((F.coalesce(F.sum(c), F.lit(0)) for c in flags), F.lit(0)).cast("long")
            self.df, seen = _write_observed(self.flagged, flags, outliers=total)
            self.outliers = seen["outliers"]
        return self.df

    def report(self) -> DataFrame:
        """Duplicates removed, columns dropped (count, names), outliers capped; all observed while the stages were written."""
        spark = self.stored().sparkSession
        row = (self.duplicates, len(self.dropped_columns), ",".join(self.dropped_columns), self.outliers)
        return spark.createDataFrame([row], "duplicates_removed long, columns_dropped long, dropped_column_names string, outliers_handled long")


def clean_numeric(df: DataFrame, spec: PanelSpec, keywords=NON_NEGATIVE_KEYWORDS) -> DataFrame:
    """F2 + F3: +-Inf -> null on every numeric metric; negatives -> 0 where the
    name contains one of ``keywords``."""
    out = {}
    for c in spec.numeric_columns(df):
        e = inf_to_null(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        if non_negative_name(c, keywords):
            e = clamp_negative(e)
        out[c] = e
    return df.withColumns(out) if out else df


def clean_pipeline(df: DataFrame, spec: PanelSpec, threshold: float = NULL_THRESHOLD,
                   method: str = "iqr", factor: float = IQR_CAP_FACTOR, materialize=cut_lineage) -> CleanResult:
    """Dedupe (A7) -> null-ratio pruning (P17, the one data-dependent
    step) -> invalid-date removal (P14) -> Inf/negative repair (F2, F3) ->
    outlier capping (W6, or W7 with ``method='zscore'``).

    The de-duplicated panel is stored; the job that writes it also counts its
    input rows and the nulls of every column, so the null-ratio step needs no
    scan of its own. With ``materialize=None`` nothing is stored and the null
    ratios take one aggregation (and duplicates are not counted).
    """
    E, T = spec.entity, spec.time
    dedupe = dedupe_last if (E in df.columns and T in df.columns) else dedupe_rows
    if materialize is None:
        dedup, duplicates = dedupe(df, spec), None
        dropped = null_ratio_columns(dedup, threshold)
    else:
        before, after = Observation(), Observation()
        dedup = dedupe(df.observe(before, F.count(F.lit(1)).alias("rows")), spec)
        nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(dedup.columns)]
        dedup = materialize(dedup.observe(after, F.count(F.lit(1)).alias("rows"), *nulls))
        seen = after.get
        duplicates = before.get["rows"] - seen["rows"]
        dropped = [c for i, c in enumerate(dedup.columns)
                   if seen[f"n{i}"] > threshold * seen["rows"] and c not in ESSENTIAL_COLUMNS]
    d = dedup.drop(*dropped)
    if T in d.columns:
        if dict(d.dtypes)[T] not in ("date",):
            from panelkit.functions.scalar import parse_date
            d = d.withColumn(T, parse_date(F.col(T).cast("string")))
        d = d.where(F.col(T).isNotNull())
    d = clean_numeric(d, spec)
    if method == "iqr":
        flagged = W.cap_iqr(d, spec, factor=factor, flag_prefix=FLAG)
    elif method == "zscore":
        flagged = W.cap_zscore(d, spec, factor=factor, flag_prefix=FLAG)
    else:
        flagged = d
    out = flagged.drop(*[c for c in flagged.columns if c.startswith(FLAG)])
    return CleanResult(out, dropped, duplicates, flagged)


# ---------------------------------------------------------------- imputation

@dataclass
class ImputeResult:
    df: DataFrame
    tracked: DataFrame
    counters: list[str] = field(default_factory=list)
    seen: dict | None = None

    def stored(self) -> DataFrame:
        """The imputed panel, written once; the nulls before and after each step are counted by the job that writes it."""
        if self.seen is None:
            sums = {c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in self.counters}
            self.df, self.seen = _write_observed(self.tracked, self.counters, **sums)
        return self.df

    def report(self) -> DataFrame:
        """forward_filled, interpolated, filled_with_stats, filled_new_with_zero; observed while the result was written."""
        spark = self.stored().sparkSession
        n = self.seen
        row = (n["_b2"] - n["_a2"], n["_b4"] - n["_a4"], n["_b5"] - n["_a5"], n["_b3"])
        return spark.createDataFrame([row], "forward_filled long, interpolated long, filled_with_stats long, filled_new_with_zero long")


def _nulls(cols) -> F.Column:
    """Number of nulls among ``cols`` in the row (one SQL expression)."""
    if not cols:
        return F.lit(0)
    return F.expr(" + ".join(f"CAST(`{c}` IS NULL AS INT)" for c in cols))


def impute_pipeline(df: DataFrame, spec: PanelSpec, method: str = "median") -> ImputeResult:
    """Static fill (W1) -> forward fill (W2) -> zero fill (W3) ->
    bounded interpolation (W4) -> entity median/mean (W5).

    All stages are windows partitioned by the entity, so the plan keeps one
    exchange; per-row null counters ride along for the report.
    """
    d = W.static_fill(df, spec)
    ff = W.forward_fill_columns(d, spec)
    d = d.withColumn("_b2", _nulls(ff))
    d = W.forward_fill(d, spec, ff)
    d = d.withColumn("_a2", _nulls(ff))
    zc = [c for c in W.zero_fill_columns(d, spec) if not c.startswith("_")]
    d = d.withColumn("_b3", _nulls(zc))
    d = W.zero_fill(d, spec, zc)
    ic = [c for c in W.interpolate_columns(d, spec) if not c.startswith("_")]
    d = d.withColumn("_b4", _nulls(ic))
    d = W.interpolate_bounded(d, spec, ic)
    d = d.withColumn("_a4", _nulls(ic))
    sc = [c for c in W.stat_fill_columns(d, spec) if not c.startswith("_")]
    d = d.withColumn("_b5", _nulls(sc))
    d = W.fill_statistic(d, spec, sc, method)
    d = d.withColumn("_a5", _nulls(sc))
    counters = ["_b2", "_a2", "_b3", "_b4", "_a4", "_b5", "_a5"]
    return ImputeResult(d.drop(*counters), d, counters)


# ---------------------------------------------------------------- features

def add_ratios(df: DataFrame, table) -> DataFrame:
    """Columns of a table (result, numerator, denominator, factor, only if absent) whose inputs are there."""
    have = set(df.columns)
    todo = {name: safe_div(top, below, factor) for name, top, below, factor, absent in table
            if {top, below} <= have and not (absent and name in have)}
    return df.withColumns(todo) if todo else df


def per_capita(df: DataFrame, spec: PanelSpec, table=PER_CAPITA) -> DataFrame:
    """per million / per thousand of the weight column, only if absent."""
    return add_ratios(df, [(name, top, spec.weight, factor, True) for name, top, factor in table])


def rate_features(df: DataFrame, table=RATES) -> DataFrame:
    """fatality %, positivity % (if absent), coverage %, ICU/hospital %."""
    return add_ratios(df, table)


def feature_pipeline(df: DataFrame, spec: PanelSpec, include_difference: bool = False,
                     drop: bool = True) -> DataFrame:
    """Calendar + days since first (F6, W14) -> per capita (F5) -> rates
    (F4) -> moving averages (W8) -> growth (W10) -> lags (W11) -> running
    totals (W12) -> [difference (W13)] -> drop intermediates (P4)."""
    d = W.calendar_features(df, spec)
    d = W.days_since_first(d, spec)
    d = per_capita(d, spec)
    d = rate_features(d)
    d = W.moving_average(d, spec)
    d = W.growth_rate(d, spec)
    d = W.lag_features(d, spec)
    d = W.running_total(d, spec)
    if include_difference:
        d = W.first_difference(d, spec)
    return drop_intermediate(d) if drop else d


# ---------------------------------------------------------------- full ETL

@dataclass
class EtlResult:
    df: DataFrame
    clean: CleanResult
    impute: ImputeResult


def etl_pipeline(raw: DataFrame, spec: PanelSpec, checkpoint: bool = True) -> EtlResult:
    """World rollup (A5) -> clean (X1) -> impute (X2) -> features.

    The de-duplicated panel is stored in the shared checkpoint folder, with
    its null counts taken by the job that writes it: that cuts the plan before
    the window-heavy stages, and a lost executor recomputes from the stored
    panel instead of from the raw scan.
    """
    rolled = world_rollup(raw, spec)
    cl = clean_pipeline(rolled, spec, materialize=cut_lineage if checkpoint else None)
    im = impute_pipeline(cl.df, spec)
    return EtlResult(feature_pipeline(im.df, spec), cl, im)
