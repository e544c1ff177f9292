"""Per-entity operators for entities too large for one task.

The plain window operators sort an entity in one task. Here every entity is
cut by time into segments at borders that a quantile sketch of the whole
panel's times gives, so an entity with half of all rows lies in about half of
the segments. Windows run inside (entity, segment); what an operator needs from
outside is carried in:

1. each segment is summed up (last and first known value with their places,
   sums, number of rows, last few rows) with an aggregate over the same keys;
2. the summaries of an entity, one row a segment, are scanned by a window;
3. they are joined back on (entity, segment) and combined with the segment's own window.

The window, the aggregate and the join share one partitioning by (entity,
segment). Medians and quartiles come from ``stats.quantile_columns``, which
never holds an entity's values in one task. Results equal the plain operators'.
Rows of one entity at one moment stay in one segment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators import windows as W
from panelkit.operators.joins import null_safe_join
from panelkit.operators.stats import BINS, binned, border_sketch, quantile_columns, with_bin
from panelkit.spec import FLOW_FEATURE_COLUMNS, INTERPOLATION_LIMIT, IQR_CAP_FACTOR, MA_WINDOWS, RUNNING_TOTAL_MAP, STATIC_COLUMNS, PanelSpec

SEGMENT_ROWS = 1_000_000
SEG, ROW = "_seg", "_row"
UNB = Window.unboundedPreceding


def with_segments(df: DataFrame, spec: PanelSpec, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds ``_seg``: segments of about ``rows`` rows of the panel by time (at most 1,024); rows without a time come last."""
    at = F.col(spec.time).cast("timestamp").cast("double")
    seen = df.agg(F.count(F.lit(1)).alias("n"), border_sketch(at).alias("b")).first()
    n = min(BINS, max(1, math.ceil(seen["n"] / rows)))
    found = with_bin(df, f"CAST(CAST(`{spec.time}` AS TIMESTAMP) AS DOUBLE)", [seen["b"]])
    return found.withColumn(SEG, F.when(at.isNull(), n).otherwise(F.floor(F.col("_bin") * n / BINS)).cast("int")).drop("_bin")


def _local(spec: PanelSpec) -> Window:
    return Window.partitionBy(spec.entity, SEG).orderBy(F.col(spec.time).asc_nulls_last(), F.col(spec.ord).asc_nulls_last())


def _numbered(df: DataFrame, spec: PanelSpec, rows: int) -> DataFrame:
    """The panel with its segment and the place of each row in it."""
    return with_segments(df, spec, rows).withColumn(ROW, F.row_number().over(_local(spec)))


def _carried(d: DataFrame, spec: PanelSpec, sums: dict[str, Column], scans: dict[str, Column]) -> DataFrame:
    """``d`` with the ``scans`` (windows over an entity's segment summaries ``sums``) of its segment."""
    keys = [spec.entity, SEG]
    parts = d.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    parts = parts.select(*keys, *[v.alias(k) for k, v in scans.items()])
    return null_safe_join(d, parts, keys, "left")


def _segments(spec: PanelSpec) -> Window:
    return Window.partitionBy(spec.entity).orderBy(SEG)


def _before(spec: PanelSpec) -> Window:
    return _segments(spec).rowsBetween(UNB, -1)


def _after(spec: PanelSpec) -> Window:
    """The segments after this one, nearest first: the reversed order's earlier rows."""
    return Window.partitionBy(spec.entity).orderBy(F.col(SEG).desc()).rowsBetween(UNB, -1)


def _known(c: str, value: Column, how=F.max_by) -> Column:
    """The value at the last (``min_by``: first) row of the segment where ``c`` is known."""
    return how(value, F.when(F.col(c).isNotNull(), F.col(ROW)))


def _finish(d: DataFrame, spec: PanelSpec, out: dict[str, Column], columns) -> DataFrame:
    d = d.withColumns({k: W.by_entity(spec, v) for k, v in out.items()})
    return d.select(*columns, *[k for k in out if k not in columns])


def forward_fill(df: DataFrame, spec: PanelSpec, cols=None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The last known value, from this segment or an earlier one."""
    cols = W.forward_fill_columns(df, spec) if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return df
    d = _carried(_numbered(df, spec, rows), spec, {f"_l_{c}": _known(c, F.col(c)) for c in cols},
                 {f"_in_{c}": F.last(f"_l_{c}", True).over(_before(spec)) for c in cols})
    here = _local(spec).rowsBetween(UNB, 0)
    return _finish(d, spec, {c: F.coalesce(F.last(c, True).over(here), F.col(f"_in_{c}")) for c in cols}, df.columns)


def static_fill(df: DataFrame, spec: PanelSpec, cols=None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The last known value, before the first one the first."""
    cols = [c for c in (STATIC_COLUMNS if cols is None else cols) if c in df.columns]
    if not cols:
        return df
    whole = _segments(spec).rowsBetween(UNB, Window.unboundedFollowing)
    d = _carried(_numbered(df, spec, rows), spec,
                 {f"_l_{c}": _known(c, F.col(c)) for c in cols} | {f"_f_{c}": _known(c, F.col(c), F.min_by) for c in cols},
                 {f"_in_{c}": F.last(f"_l_{c}", True).over(_before(spec)) for c in cols}
                 | {f"_first_{c}": F.first(f"_f_{c}", True).over(whole) for c in cols})
    here = _local(spec).rowsBetween(UNB, 0)
    return _finish(d, spec, {c: F.coalesce(F.last(c, True).over(here), F.col(f"_in_{c}"), F.col(f"_first_{c}")) for c in cols}, df.columns)


def running_total(df: DataFrame, spec: PanelSpec, mapping=None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """``total_X`` as the running sum of ``new_X`` when absent; null inputs give 0."""
    mapping = RUNNING_TOTAL_MAP if mapping is None else mapping
    todo = {a: b for a, b in mapping.items() if a in df.columns and b not in df.columns}
    if not todo:
        return df
    d = _carried(_numbered(df, spec, rows), spec, {f"_s_{c}": F.sum(c) for c in todo},
                 {f"_in_{c}": F.coalesce(F.sum(f"_s_{c}").over(_before(spec)), F.lit(0.0)) for c in todo})
    here = _local(spec).rowsBetween(UNB, 0)
    out = _finish(d, spec, {b: F.when(F.col(a).isNotNull(), F.sum(a).over(here) + F.col(f"_in_{a}")) for a, b in todo.items()}, df.columns)
    return out.fillna(0.0, subset=list(todo.values()))


def moving_average(df: DataFrame, spec: PanelSpec, cols=None, windows=MA_WINDOWS, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Trailing row-window mean; the first rows of a segment also look at the last rows of the segments before."""
    cols = [c for c in (FLOW_FEATURE_COLUMNS if cols is None else cols) if c in df.columns]
    most = max(windows) - 1
    d = _numbered(df, spec, rows)
    size = F.count(F.lit(1)).over(Window.partitionBy(spec.entity, SEG))
    d = d.withColumn("_left", size - F.col(ROW))
    # every earlier segment has a row, so the last rows lie in the nearest ``most`` segments
    near = _segments(spec).rowsBetween(-most, -1) if most else None
    if most:
        tail = F.sort_array(F.collect_list(F.when(F.col("_left") < most, F.struct(F.col(ROW), *[F.col(c).cast("double").alias(c) for c in cols]))))
        d = _carried(d, spec, {"_tail": tail}, {"_tails": F.flatten(F.collect_list("_tail").over(near))})
    out = {}
    for c in cols:
        for w in windows:
            frame = _local(spec).rowsBetween(-(w - 1), 0)
            total, known = F.coalesce(F.sum(c).over(frame), F.lit(0.0)), F.count(c).over(frame)
            if w > 1:
                lack = F.greatest(F.lit(w) - F.col(ROW), F.lit(0))
                begin = F.greatest(F.size("_tails") - lack, F.lit(0)) + 1
                values = F.filter(F.slice(F.col("_tails"), begin, lack)[c], lambda x: x.isNotNull())
                total = total + F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
                known = known + F.size(values)
            out[f"{c}_ma{w}"] = F.when(known > 0, total / known)
    return _finish(d, spec, out, df.columns)


def interpolate_bounded(df: DataFrame, spec: PanelSpec, cols=None, limit: int = INTERPOLATION_LIMIT, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Linear interpolation between the nearest knots on either side, in this segment or another."""
    cols = W.interpolate_columns(df, spec) if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return df
    knot = lambda c, how: _known(c, F.struct(F.col(ROW).alias("n"), F.col(c).cast("double").alias("v")), how)
    sums = {"_rows": F.count(F.lit(1))}
    scans = {"_off": F.coalesce(F.sum("_rows").over(_before(spec)), F.lit(0))}
    for c in cols:
        sums |= {f"_l_{c}": knot(c, F.max_by), f"_f_{c}": knot(c, F.min_by)}
    parts = _numbered(df, spec, rows)
    keys = [spec.entity, SEG]
    found = parts.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    found = found.withColumn("_off", scans["_off"])
    # places in the segment become places in the entity before they are carried
    shift = {f"_{s}_{c}": F.when(F.col(f"_{s}_{c}").isNotNull(), F.struct(
        (F.col(f"_{s}_{c}.n") + F.col("_off")).alias("n"), F.col(f"_{s}_{c}.v").alias("v"))) for c in cols for s in "lf"}
    found = found.withColumns(shift)
    found = found.select(*keys, "_off",
                         *[F.last(f"_l_{c}", True).over(_before(spec)).alias(f"_p_{c}") for c in cols],
                         *[F.last(f"_f_{c}", True).over(_after(spec)).alias(f"_q_{c}") for c in cols])
    d = null_safe_join(parts, found, keys, "left")
    n, here = F.col(ROW) + F.col("_off"), _local(spec)
    behind = here.rowsBetween(UNB, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(spec.time).desc_nulls_first(), F.col(spec.ord).desc_nulls_first()).rowsBetween(UNB, 0)
    own = {f"_k_{c}": F.when(F.col(c).isNotNull(), F.struct(n.alias("n"), F.col(c).cast("double").alias("v"))) for c in cols}
    d = d.withColumns(own)
    d = d.withColumns({f"_a_{c}": F.coalesce(F.last(f"_k_{c}", True).over(behind), F.col(f"_p_{c}")) for c in cols}
                      | {f"_b_{c}": F.coalesce(F.last(f"_k_{c}", True).over(ahead), F.col(f"_q_{c}")) for c in cols})
    out = {}
    for c in cols:
        p, q = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        back, on = n - p["n"], q["n"] - n
        line = (q["v"] - p["v"]) / (q["n"] - p["n"]) * back + p["v"]
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(p.isNotNull() & q.isNotNull() & ((back <= limit) | (on <= limit)), line)
                  .when(p.isNull() & q.isNotNull() & (on <= limit), q["v"])
                  .when(q.isNull() & p.isNotNull() & (back <= limit), p["v"]))
    return _finish(d, spec, out, df.columns)


def entity_statistics(df: DataFrame, spec: PanelSpec, cols, named: dict | None) -> DataFrame:
    """One row an entity: exact quantiles ``{c}_{name}`` (``named=None``: the mean ``{c}_mean``) of many columns.

    All columns go through one set of bins; counts per (entity, column, bin) are aggregated before they are shuffled.
    """
    E = spec.entity
    if named is None:
        return df.where(F.col(E).isNotNull()).groupBy(E).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])
    long = df.where(F.col(E).isNotNull()).select(E, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([E], list(cols), "_c", "_v")
    q = quantile_columns(long, [E, "_c"], "_v", named, rows=binned(long, "_v", [E, "_c"]))
    return q.groupBy(E).agg(*[F.max(F.when(F.col("_c") == c, F.col(k))).alias(f"{c}_{k}") for c in cols for k in named])


def fill_statistic(df: DataFrame, spec: PanelSpec, cols=None, method: str = "median") -> DataFrame:
    """Remaining nulls take the entity's median (default) or mean."""
    cols = W.stat_fill_columns(df, spec) if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return df
    name = "mean" if method == "mean" else "median"
    stats = entity_statistics(df, spec, cols, None if name == "mean" else {"median": 0.5})
    d = df.join(stats, spec.entity, "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_{name}")) for c in cols}).select(*df.columns)


def cap_iqr(df: DataFrame, spec: PanelSpec, cols=None, factor: float = IQR_CAP_FACTOR) -> DataFrame:
    """Per-entity capping at Q1-f*IQR / Q3+f*IQR."""
    cols = W.outlier_columns(df, spec) if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return df
    stats = entity_statistics(df, spec, cols, {"q1": 0.25, "q3": 0.75})
    d = df.join(stats, spec.entity, "left")
    out = {}
    for c in cols:
        v, q1, q3 = F.col(c), F.col(f"{c}_q1"), F.col(f"{c}_q3")
        lo, hi = q1 - F.lit(factor) * (q3 - q1), q3 + F.lit(factor) * (q3 - q1)
        out[c] = F.when(v < lo, lo).when(v > hi, hi).otherwise(v)
    return d.withColumns(out).select(*df.columns)
