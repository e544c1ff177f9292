"""Per-entity window operators (W1-W14) and the calendar features.

Frames are row based: a missing day makes a 7-row frame span more days.
Every window is partitioned by the entity only, so stacked operators share
one exchange and one sort. A panel has at most one row per (entity, day)
after de-duplication, so an entity's partition is bounded by the number of
days whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import clip_keep_null
from panelkit.spec import (
    CENTERED_WINDOW, DIFFERENCE_COLUMNS, FLOW_FEATURE_COLUMNS, GROWTH_CLIP, GROWTH_COLUMNS,
    GROWTH_PERIODS, IMPUTE_STATIC_EXCLUDE, INTERPOLATION_LIMIT, IQR_CAP_FACTOR, LAGS, MA_WINDOWS,
    OUTLIER_EXCLUDE, RUNNING_TOTAL_MAP, STATIC_COLUMNS, PanelSpec,
)

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


def w_entity(spec: PanelSpec) -> Window:
    return Window.partitionBy(*spec.partition)


def w_time(spec: PanelSpec) -> Window:
    return Window.partitionBy(*spec.partition).orderBy(
        F.col(spec.time).asc_nulls_last(), F.col(spec.ord).asc_nulls_last())


def w_prev(spec: PanelSpec) -> Window:
    return w_time(spec).rowsBetween(UNB, 0)


def w_whole(spec: PanelSpec) -> Window:
    return w_time(spec).rowsBetween(UNB, UNF)


def w_next(spec: PanelSpec) -> Window:
    """Rows at or after the current one, as the reversed order's running frame.

    An unbounded-following frame is recomputed per row; the reversed order
    with an unbounded-preceding frame gives the same values in linear time.
    """
    return Window.partitionBy(*spec.partition).orderBy(
        F.col(spec.time).desc_nulls_first(), F.col(spec.ord).desc_nulls_first()).rowsBetween(UNB, 0)


def by_entity(spec: PanelSpec, expr: Column) -> Column:
    """Rows without an entity get null, as a group transform leaves them out."""
    return F.when(F.col(spec.entity).isNotNull(), expr)


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def _positive_ints(xs, what: str):
    if not xs or not all(isinstance(x, int) and not isinstance(x, bool) and x > 0 for x in xs):
        raise ValueError(f"{what}: whole numbers above 0 are needed, got {xs!r}")


# ---------------------------------------------------------------- imputation

def static_fill(df: DataFrame, spec: PanelSpec, cols=None) -> DataFrame:
    """Forward fill then backward fill per entity."""
    cols = _present(df, STATIC_COLUMNS if cols is None else cols)
    if not cols:
        return df
    prev, whole = w_prev(spec), w_whole(spec)
    return df.withColumns({
        c: by_entity(spec, F.coalesce(F.last(c, True).over(prev), F.first(c, True).over(whole)))
        for c in cols})


def forward_fill_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    return [c for c in spec.numeric_columns(df) if "total" in c.lower() and "total_boosters" not in c]


def forward_fill(df: DataFrame, spec: PanelSpec, cols=None) -> DataFrame:
    """Last non-null value per entity for stock columns."""
    cols = forward_fill_columns(df, spec) if cols is None else _present(df, cols)
    if not cols:
        return df
    prev = w_prev(spec)
    return df.withColumns({c: by_entity(spec, F.last(c, True).over(prev)) for c in cols})


def zero_fill_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    return [c for c in spec.numeric_columns(df) if "new_" in c.lower()]


def zero_fill(df: DataFrame, spec: PanelSpec, cols=None) -> DataFrame:
    """Nulls of flow columns become 0."""
    cols = zero_fill_columns(df, spec) if cols is None else _present(df, cols)
    return df.fillna(0, subset=cols) if cols else df


def interpolate_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    skip = set(IMPUTE_STATIC_EXCLUDE)
    return [c for c in spec.numeric_columns(df) if c not in skip and "new_" not in c.lower()]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _frame_sql(spec: PanelSpec, desc: bool = False, frame: str = "") -> str:
    o = "DESC NULLS FIRST" if desc else "ASC NULLS LAST"
    return f"PARTITION BY {', '.join(map(_q, spec.partition))} ORDER BY {_q(spec.time)} {o}, {_q(spec.ord)} {o} {frame}"


def interpolate_bounded(df: DataFrame, spec: PanelSpec, cols=None, limit: int = INTERPOLATION_LIMIT) -> DataFrame:
    """Linear interpolation by row position, both directions, bounded.

    A null at position n between knots p and q takes the straight line
    through them; before the first / after the last knot it takes that knot's
    value. It is filled only if n-p <= limit or q-n <= limit, so the middle of
    a gap longer than 2*limit stays null. Written as one SQL expression per
    column (one call to build instead of dozens of Column objects).
    """
    cols = interpolate_columns(df, spec) if cols is None else _present(df, cols)
    if not cols:
        return df
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    prev, nxt = _frame_sql(spec, False, run), _frame_sql(spec, True, run)
    d = df.withColumn("_n", F.row_number().over(w_time(spec)))
    out = {}
    for c in cols:
        v = _q(c)
        pn = f"(max(CASE WHEN {v} IS NOT NULL THEN _n END) OVER ({prev}))"
        pv = f"(last({v}, true) OVER ({prev}))"
        qn = f"(min(CASE WHEN {v} IS NOT NULL THEN _n END) OVER ({nxt}))"
        qv = f"(last({v}, true) OVER ({nxt}))"
        out[c] = F.expr(
            f"CASE WHEN {_q(spec.entity)} IS NULL THEN NULL "
            f"WHEN {v} IS NOT NULL THEN {v} "
            f"WHEN {pn} IS NOT NULL AND {qn} IS NOT NULL AND (_n - {pn} <= {limit} OR {qn} - _n <= {limit}) "
            f"THEN ({qv} - {pv}) / ({qn} - {pn}) * (_n - {pn}) + {pv} "
            f"WHEN {pn} IS NULL AND {qn} IS NOT NULL AND {qn} - _n <= {limit} THEN {qv} "
            f"WHEN {qn} IS NULL AND {pn} IS NOT NULL AND _n - {pn} <= {limit} THEN {pv} END")
    return d.withColumns(out).drop("_n")


def stat_fill_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    skip = set(IMPUTE_STATIC_EXCLUDE)
    return [c for c in spec.numeric_columns(df) if c not in skip]


def fill_statistic(df: DataFrame, spec: PanelSpec, cols=None, method: str = "median") -> DataFrame:
    """Remaining nulls take the entity's median (default) or mean."""
    cols = stat_fill_columns(df, spec) if cols is None else _present(df, cols)
    if not cols:
        return df
    we = w_entity(spec)
    stat = (lambda c: F.avg(c)) if method == "mean" else (lambda c: F.percentile(c, 0.5))
    return df.withColumns({c: F.coalesce(F.col(c), by_entity(spec, stat(c).over(we))) for c in cols})


# ---------------------------------------------------------------- outliers

def outlier_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    skip = set(OUTLIER_EXCLUDE)
    return [c for c in spec.numeric_columns(df) if c not in skip]


def iqr_bounds(spec: PanelSpec, c: str, factor: float):
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(w_entity(spec))
    q1, q3 = q.getItem(0), q.getItem(1)
    iqr = q3 - q1
    return by_entity(spec, q1 - F.lit(factor) * iqr), by_entity(spec, q3 + F.lit(factor) * iqr)


def cap_iqr(df: DataFrame, spec: PanelSpec, cols=None, factor: float = IQR_CAP_FACTOR,
            flag_prefix: str | None = None) -> DataFrame:
    """Per-entity IQR capping at Q1-f*IQR / Q3+f*IQR (linear quartiles).

    With ``flag_prefix`` an int column per metric counts the capped values.
    """
    cols = outlier_columns(df, spec) if cols is None else _present(df, cols)
    if not cols:
        return df
    lohi = {}
    for c in cols:
        lo, hi = iqr_bounds(spec, c, factor)
        lohi[f"_lo_{c}"], lohi[f"_hi_{c}"] = lo, hi
    d = df.withColumns(lohi)
    out = {}
    for c in cols:
        v, lo, hi = F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        if flag_prefix:
            out[f"{flag_prefix}{c}"] = ((v < lo) | (v > hi)).cast("int")
        out[c] = F.when(v < lo, lo).when(v > hi, hi).otherwise(v)
    return d.withColumns(out).drop(*lohi.keys())


def cap_zscore(df: DataFrame, spec: PanelSpec, cols=None, factor: float = IQR_CAP_FACTOR,
               flag_prefix: str | None = None) -> DataFrame:
    """Per-entity z-score capping; a zero or undefined std marks no outlier."""
    cols = outlier_columns(df, spec) if cols is None else _present(df, cols)
    if not cols:
        return df
    we = w_entity(spec)
    st = {}
    for c in cols:
        st[f"_m_{c}"] = by_entity(spec, F.avg(c).over(we))
        sd = F.stddev_samp(c).over(we)
        st[f"_s_{c}"] = by_entity(spec, F.when(sd != 0, sd))
    d = df.withColumns(st)
    out = {}
    for c in cols:
        v, m, s = F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")
        z = F.coalesce((v - m) / s, F.lit(0.0))
        if flag_prefix:
            out[f"{flag_prefix}{c}"] = ((z < -factor) | (z > factor)).cast("int")
        out[c] = F.when(z < -factor, m - F.lit(factor) * s).when(z > factor, m + F.lit(factor) * s).otherwise(v)
    return d.withColumns(out).drop(*st.keys())


# ---------------------------------------------------------------- features

def moving_average(df: DataFrame, spec: PanelSpec, cols=None, windows=MA_WINDOWS) -> DataFrame:
    """Trailing row-window mean, min_periods 1 (nulls skipped)."""
    windows = list(windows)
    _positive_ints(windows, "Windows")
    cols = _present(df, FLOW_FEATURE_COLUMNS if cols is None else cols)
    wt = w_time(spec)
    return df.withColumns({
        f"{c}_ma{w}": by_entity(spec, F.avg(c).over(wt.rowsBetween(-(w - 1), 0)))
        for c in cols for w in windows})


def centered_average(df: DataFrame, spec: PanelSpec, cols, window: int = CENTERED_WINDOW) -> DataFrame:
    """Centred row-window mean, min_periods 1."""
    _positive_ints([window], "Window")
    left = window // 2
    right = window - 1 - left
    wt = w_time(spec).rowsBetween(-left, right)
    return df.withColumns({f"{c}_avg_{window}": by_entity(spec, F.avg(c).over(wt)) for c in _present(df, cols)})


def growth_rate(df: DataFrame, spec: PanelSpec, cols=None, periods: int = GROWTH_PERIODS,
                clip: float = GROWTH_CLIP) -> DataFrame:
    """Percent change over ``periods`` rows of the forward-filled series,
    +-Inf -> null, clipped to [-clip, clip]."""
    cols = _present(df, GROWTH_COLUMNS if cols is None else cols)
    if not cols:
        return df
    prev, wt = w_prev(spec), w_time(spec)
    d = df.withColumns({f"_ff_{c}": F.last(c, True).over(prev) for c in cols})
    out = {}
    for c in cols:
        ff = F.col(f"_ff_{c}")
        g = (F.try_divide(ff, F.lag(ff, periods).over(wt)) - F.lit(1.0)) * F.lit(100.0)
        out[f"{c}_growth_rate"] = by_entity(spec, clip_keep_null(g, -clip, clip))
    return d.withColumns(out).drop(*[f"_ff_{c}" for c in cols])


def lag_features(df: DataFrame, spec: PanelSpec, cols=None, lags=LAGS) -> DataFrame:
    """Values ``k`` rows earlier within the entity."""
    lags = list(lags)
    _positive_ints(lags, "Lags")
    cols = _present(df, FLOW_FEATURE_COLUMNS if cols is None else cols)
    wt = w_time(spec)
    return df.withColumns({f"{c}_lag{k}": by_entity(spec, F.lag(c, k).over(wt)) for c in cols for k in lags})


def running_total(df: DataFrame, spec: PanelSpec, mapping=None) -> DataFrame:
    """``total_X`` as the running sum of ``new_X`` when absent; null
    inputs give null, then 0."""
    mapping = RUNNING_TOTAL_MAP if mapping is None else mapping
    todo = {src: dst for src, dst in mapping.items() if src in df.columns and dst not in df.columns}
    if not todo:
        return df
    prev = w_prev(spec)
    return df.withColumns({
        dst: F.coalesce(F.when(F.col(src).isNotNull(), by_entity(spec, F.sum(src).over(prev))), F.lit(0.0))
        for src, dst in todo.items()})


def first_difference(df: DataFrame, spec: PanelSpec, cols=None) -> DataFrame:
    """Change from the previous row."""
    cols = _present(df, DIFFERENCE_COLUMNS if cols is None else cols)
    wt = w_time(spec)
    return df.withColumns({f"{c}_diff": F.col(c) - by_entity(spec, F.lag(c, 1).over(wt)) for c in cols})


def days_since_first(df: DataFrame, spec: PanelSpec, name: str = "days_since_first_case") -> DataFrame:
    """Days since the entity's first record."""
    T = spec.time
    return df.withColumn(name, by_entity(spec, F.datediff(F.col(T), F.min(T).over(w_entity(spec)))))


def calendar_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """year, month, day, weekday (Monday=0), ISO week, quarter, weekend flag."""
    t = F.col(spec.time)
    return df.withColumns({
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
        "day_of_week": F.weekday(t), "week_of_year": F.weekofyear(t),
        "quarter": F.quarter(t), "is_weekend": (F.weekday(t) >= 5).cast("int"),
    })
