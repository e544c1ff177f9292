"""Cross-section statistics.

A cross-section has one row per entity, so it grows with the number of
entities. Ranks and exact quantiles are therefore never computed with a
window over the whole column (one task) nor with an exact ``percentile``
aggregate (all distinct values merged in one task). Instead:

1. The values are stored once as a narrow table; all later steps read it.
2. A mergeable quantile sketch (``percentile_approx``) gives the borders of
   ``BINS`` bins. Its rank error is below 1 / ACCURACY, so without ties a bin
   holds at most 1 / BINS + 2 / ACCURACY of the rows, however they are spread.
   The borders go through the driver (BINS numbers), so that every later step
   uses the same ones.
3. Rows per (key, bin) are counted with a partial aggregation; a running sum
   of these counts (a table of keys x BINS rows at most) says where a bin begins.
4. A quantile looks only at the bins that hold its two places; a rank numbers
   the distinct values inside each bin. Equal values are collapsed by a
   partial aggregation first, so a hot value is one row a task.

One set of borders serves all keys: a bin of one key is never larger than the
bin of all. Null values have no rank, and null keys are a group of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import sign_label
from panelkit.operators.joins import BROADCAST_MAX_BYTES, join_one_row, join_small, null_safe_join, plan_size_bytes
from panelkit.session import cut_lineage
from panelkit.spec import (
    HIGHER_IS_BETTER, HISTOGRAM_BINS, LOWER_IS_BETTER, MIN_CORRELATION_ROWS, TOP_K, TRIM_FACTOR,
)

BINS = 1024  # a power of two: a value finds its bin by halving
ACCURACY = 20_000


def _is_value(value: str) -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v.cast("double"))


def _constant(numbers, kind: str) -> str:
    """SQL of an array that the planner folds to one value; a call of ``array`` with a thousand literals would slow every rule down."""
    return f"CAST(split('{','.join(repr(x) for x in numbers)}', ',') AS ARRAY<{kind}>)"


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def border_sketch(value: Column) -> Column:
    """Aggregate: the BINS - 1 borders of a column, null where it has no values."""
    return F.percentile_approx(value, F.expr(_constant([i / BINS for i in range(1, BINS)], "DOUBLE")), ACCURACY)


def with_bin(df: DataFrame, value: str, borders: list[list[float] | None], number: str = "0") -> DataFrame:
    """Adds ``_bin``: how many borders lie below the SQL value; ``number`` (from 0) selects among several lists of borders.

    The place is found by halving, ten steps for 1,024 bins.
    """
    if not any(borders):
        return df.withColumn("_bin", F.lit(0))
    listed = _constant([float(x) for b in borders for x in (b or [0.0] * (BINS - 1))], "DOUBLE")
    halves = _constant([BINS >> k for k in range(1, BINS.bit_length())], "INT")
    return df.withColumn("_bin", F.expr(f"aggregate({halves}, 0, (_a, _h) -> _a + CASE WHEN element_at({listed}, {BINS - 1} * {number} + _a + _h) "
                                        f"< {value} THEN _h ELSE 0 END)"))


def binned(df: DataFrame, value: str, keep=(), store: bool = True) -> DataFrame:
    """The rows with a value: columns ``keep``, the value and its ``_bin``; stored as a narrow table unless ``df`` already is one."""
    rows = df.where(_is_value(value)).select(*dict.fromkeys([*keep, value]))
    if store:
        rows = cut_lineage(rows)
    as_double = f"CAST({_name(value)} AS DOUBLE)"
    borders = rows.agg(border_sketch(F.expr(as_double))).first()[0]
    return with_bin(rows, as_double, [borders])


def bin_offsets(rows: DataFrame, keys) -> DataFrame:
    """(keys, _bin, _in, _off, _n): rows of the key in the bin, in earlier bins and at all."""
    by = [_name(k) for k in keys]
    part = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_in"))
    of_key = f"PARTITION BY {', '.join(by)} " if by else ""
    running = f"sum(_in) OVER ({of_key}ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return part.selectExpr(*by, "_bin", "_in", f"{running} - _in AS _off", f"sum(_in) OVER ({of_key}) AS _n")


def value_positions(rows: DataFrame, offsets: DataFrame, keys, value: str) -> DataFrame:
    """(keys, value, _cnt, _before, _n) of the distinct values of ``binned`` rows in the bins of ``offsets``.

    ``_before`` = rows of the key with a smaller value, ``_n`` = all its rows.
    """
    by = [_name(c) for c in [*keys, "_bin"]]
    d = rows.groupBy(*keys, "_bin", value).agg(F.count(F.lit(1)).alias("_cnt"))
    return _numbered(null_safe_join(d, offsets.select(*keys, "_bin", "_off", "_n"), [*keys, "_bin"]), keys, value, by)


def _numbered(counts: DataFrame, keys, value: str, by) -> DataFrame:
    """Distinct values with the offset of their bin, numbered inside it."""
    inside = f"sum(_cnt) OVER (PARTITION BY {', '.join(by)} ORDER BY {_name(value)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return counts.selectExpr(*map(_name, keys), _name(value), "_cnt", f"_off + {inside} - _cnt AS _before", "_n")


def average_rank(df: DataFrame, keys, value: str, out: str = "rank", store: bool = True) -> DataFrame:
    """Average rank of the non-null values (ties share the mean of their positions, 1-based); null values get null.

    ``store=False`` is for a ``df`` that is a stored narrow table itself.
    """
    keys = list(keys or [])
    rows = binned(df, value, keys, store)
    pos = value_positions(rows, bin_offsets(rows, keys), keys, value).select(
        *keys, value, (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return null_safe_join(df, pos, [*keys, value], "left")


def _places(n, p: float):
    """Lower and upper place (0-based) of a linearly interpolated quantile, and the weight of the upper."""
    at = (n - 1) * p
    lo = math.floor(at)
    return lo, math.ceil(at), at - lo


def quantile_row(rows: DataFrame, value: str, named: dict) -> tuple[dict[str, float], int]:
    """Exact quantiles of all ``binned`` rows as numbers, and the number of rows; no rows: no quantiles.

    Two small results reach the driver: the row count of each bin, and the at
    most two values that each quantile lies between.
    """
    counts = dict(rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("c")).collect())
    n = sum(counts.values())
    if not n:
        return {}, 0
    off, begin = 0, {}
    for b in sorted(counts):
        begin[b] = off
        off += counts[b]
    places = {name: _places(n, p) for name, p in named.items()}
    asked = sorted({x for lo, hi, _ in places.values() for x in (lo, hi)})
    bins = sorted({max(b for b in begin if begin[b] <= x) for x in asked})
    here = rows.where(F.col("_bin").isin(bins)).groupBy("_bin", value).agg(F.count(F.lit(1)).alias("_cnt"))
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    first = F.expr("CASE " + " ".join(f"WHEN _bin = {b} THEN {begin[b]}" for b in bins) + " END").cast("long")
    last = first + F.sum("_cnt").over(inside) - 1
    found = here.select(F.col(value).cast("double").alias("v"), (last - F.col("_cnt") + 1).alias("a"), last.alias("b"))
    hits = found.where(" OR ".join(f"{x} BETWEEN a AND b" for x in asked)).collect()
    at = {x: next(r["v"] for r in hits if r["a"] <= x <= r["b"]) for x in asked}
    return {name: at[lo] if at[lo] == at[hi] else at[lo] + (at[hi] - at[lo]) * w for name, (lo, hi, w) in places.items()}, n


def quantile_columns(df: DataFrame, keys, value: str, named: dict, count: str | None = None,
                     rows: DataFrame | None = None) -> DataFrame:
    """Exact quantiles as columns, e.g. ``{"q1": .25, "median": .5, "q3": .75}``; one row per key with values.

    ``count`` names a further column for the number of values; ``rows`` are the
    ``binned`` rows of ``df`` (or of a larger table) if there are some already.
    The result (one row a key) carries a broadcast hint if the stored bins that
    it is taken from, which are at least as many rows, are small enough.
    """
    keys = list(keys or [])
    rows = binned(df, value, keys) if rows is None else rows
    at = {name: f"((_n - 1) * {float(p)!r}D)" for name, p in named.items()}
    wanted = " OR ".join(f"({f}({x}) >= _off AND {f}({x}) < _off + _in)" for x in at.values() for f in ("floor", "ceil"))
    bins = cut_lineage(bin_offsets(rows, keys).where(wanted).select(*keys, "_bin", "_off", "_n"))
    by = [_name(c) for c in [*keys, "_bin"]]
    renamed = bins.selectExpr(*[f"{c} AS {_name('_of_' + c[1:-1])}" for c in by], "_off", "_n")
    same = " AND ".join(f"{c} <=> {_name('_of_' + c[1:-1])}" for c in by)
    here = join_small(rows, renamed, F.expr(same)).groupBy(*keys, "_bin", "_off", "_n", value).agg(F.count(F.lit(1)).alias("_cnt"))
    aggs, out = ["first(_n) AS _n"], []
    for i, x in enumerate(at.values()):
        for side, f in (("lo", "floor"), ("hi", "ceil")):
            hit = f"_before <= {f}({x}) AND _before + _cnt - 1 >= {f}({x})"
            aggs.append(f"max(CASE WHEN {hit} THEN CAST({_name(value)} AS DOUBLE) END) AS _{side}{i}")
        out.append(f"CASE WHEN _lo{i} = _hi{i} THEN _lo{i} ELSE _lo{i} + (_hi{i} - _lo{i}) * ({x} - floor({x})) END")
    found = _numbered(here, keys, value, by).groupBy(*keys).agg(*map(F.expr, aggs)).where("_n IS NOT NULL")
    found = found.selectExpr(*map(_name, keys), *[f"{e} AS {_name(name)}" for e, name in zip(out, named)], *([f"_n AS {_name(count)}"] if count else []))
    # at most as many rows as the stored table of bins, whose size is known
    return F.broadcast(found) if plan_size_bytes(bins) <= BROADCAST_MAX_BYTES else found


def quantiles(df: DataFrame, keys, value: str, probs) -> DataFrame:
    """Exact linear-interpolated quantiles per key: (keys, p, q)."""
    keys = list(keys or [])
    wide = quantile_columns(df, keys, value, {f"_q{i}": p for i, p in enumerate(probs)})
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"_q{i}").alias("q")) for i, p in enumerate(probs)])
    return wide.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.p", "_x.q")


def trim_bounds(q1: float, q3: float, factor: float) -> tuple[float, float]:
    """The inclusive range of P15; an IQR of 0 or less counts as 1."""
    iqr = q3 - q1 if q3 - q1 > 0 else 1.0
    return q1 - factor * iqr, q3 + factor * iqr


def iqr_trim(df: DataFrame, value: str, factor: float = TRIM_FACTOR, keys=()) -> DataFrame:
    """Keep rows inside [Q1-f*IQR, Q3+f*IQR] (inclusive) when more than one
    row is present; IQR <= 0 is replaced by 1. Without keys the bounds are two
    numbers, so the filter on a stored column reaches its scan."""
    keys, v = list(keys or []), F.col(value)
    d = df.where(v.isNotNull())
    named = {"_q1": 0.25, "_q3": 0.75}
    if not keys:
        q, n = quantile_row(binned(d, value), value, named)
        if n <= 1:
            return d
        lo, hi = trim_bounds(q["_q1"], q["_q3"], factor)
        return d.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
    st = quantile_columns(d, keys, value, named, count="_n")
    iqr = F.when((F.col("_q3") - F.col("_q1")) > 0, F.col("_q3") - F.col("_q1")).otherwise(F.lit(1.0))
    st = st.select(*keys, "_n", (F.col("_q1") - factor * iqr).alias("_lo"), (F.col("_q3") + factor * iqr).alias("_hi"))
    j = null_safe_join(d, st, keys, "left")
    return j.where((F.col("_n") <= 1) | ((v >= F.col("_lo")) & (v <= F.col("_hi")))).drop("_n", "_lo", "_hi")


def iqr_trim_xy(df: DataFrame, x: str, y: str, factor: float = TRIM_FACTOR) -> DataFrame:
    """Drop nulls in x and y, trim on x, then trim on y over the x-trimmed rows."""
    d = df.dropna(subset=[x, y])
    return iqr_trim(iqr_trim(d, x, factor), y, factor)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_metric(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Mean, median, sample std, n, Q1, Q3."""
    keys = list(keys or [])
    rows = binned(df, value, keys)
    return describe_rows(rows, value, keys)


def describe_rows(rows: DataFrame, value: str, keys=()) -> DataFrame:
    """A18 over ``binned`` rows."""
    keys = list(keys)
    aggs = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n")]
    names = [*keys, "mean", "median", "std", "n", "q1", "q3"]
    if not keys:
        q, _ = quantile_row(rows, value, QUARTILES)
        return rows.agg(*aggs).withColumns({k: F.lit(q.get(k)).cast("double") for k in QUARTILES}).select(*names)
    qs = quantile_columns(rows, keys, value, QUARTILES, rows=rows)
    return null_safe_join(rows.groupBy(*keys).agg(*aggs), qs, keys, "left").select(*names)


def nearest_to_center(stats_rows: DataFrame, search_rows: DataFrame, entity: str, value: str) -> DataFrame:
    """Entity whose value is nearest to the mean and to the median of
    ``stats_rows``, searched in ``search_rows``; first entity on ties."""
    st = describe_metric(stats_rows, value).select("mean", "median")
    j = join_one_row(search_rows.where(F.col(value).isNotNull()), st)
    v = F.col(value)
    return j.agg(
        F.min_by(entity, F.struct(F.abs(v - F.col("mean")), F.col(entity))).alias("nearest_to_mean"),
        F.min_by(entity, F.struct(F.abs(v - F.col("median")), F.col(entity))).alias("nearest_to_median"),
        F.first("mean").alias("mean"),
        F.first("median").alias("median"),
    )


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equi-width bins between min and max; the max falls in the last bin."""
    d = df.where(F.col(value).isNotNull())
    mm = d.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    j = join_one_row(d, mm)
    span = F.col("_max") - F.col("_min")
    b = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("_min")) / span * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    g = j.groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_min").alias("_min"), F.first("_max").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    return g.select("bin",
                    (F.col("_min") + (F.col("bin") - 1) * width).alias("lower"),
                    (F.col("_min") + F.col("bin") * width).alias("upper"),
                    "count")


def box_fences(rows: DataFrame, value: str, group: str, factor: float = 1.5) -> DataFrame:
    """Quartiles and 1.5*IQR fences of each group of ``binned`` rows, one row a group."""
    qs = quantile_columns(rows, [group], value, QUARTILES, rows=rows)
    return qs.withColumns({
        "lower_fence": F.col("q1") - factor * (F.col("q3") - F.col("q1")),
        "upper_fence": F.col("q3") + factor * (F.col("q3") - F.col("q1")),
    })


def beside_fences(rows: DataFrame, fences: DataFrame, value: str, group: str) -> tuple[DataFrame, Column]:
    """Rows with the fences of their group (broadcast where ``quantile_columns`` allows it), and whether they lie inside."""
    v = F.col(value)
    return rows.join(fences, group), (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))


def box_stats(df: DataFrame, value: str, group: str, factor: float = 1.5, rows: DataFrame | None = None) -> DataFrame:
    """Per group quartiles, 1.5*IQR fences, whiskers (extreme values inside
    the fences) and outlier count; the points are in ``box_outliers``."""
    rows = binned(df.where(F.col(group).isNotNull()), value, [group]) if rows is None else rows
    j, inside = beside_fences(rows, box_fences(rows, value, group, factor), value, group)
    first = [F.first(c).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")]
    v = F.col(value)
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *first,
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def box_outliers(df: DataFrame, entity: str, value: str, group: str, factor: float = 1.5) -> DataFrame:
    """The points outside the fences of their group, with the fence that they cross."""
    rows = binned(df.where(F.col(group).isNotNull()), value, [entity, group])
    j, inside = beside_fences(rows, box_fences(rows, value, group, factor), value, group)
    high = F.col(value) > F.col("upper_fence")
    return j.where(~inside).select(
        group, entity, value, F.when(high, F.lit("high")).otherwise(F.lit("low")).alias("side"),
        F.when(high, F.col("upper_fence")).otherwise(F.col("lower_fence")).alias("fence"))


def spearman(df: DataFrame, entity: str, outcome: str, factors, min_rows: int = MIN_CORRELATION_ROWS) -> DataFrame:
    """Spearman correlation of ``outcome`` with each factor over the rows
    where all of them are present; no result below ``min_rows`` rows.

    An entity's ranks come back together in one aggregate, so all correlations are taken in a single pass.
    """
    factors = [f for f in factors if f in df.columns and f != outcome]
    all_of = [outcome, *factors]
    d = cut_lineage(df.dropna(subset=all_of).where(F.col(entity).isNotNull()).select(entity, *all_of))
    long = d.unpivot([entity], all_of, "factor", "value")
    ranked = average_rank(long, ["factor"], "value", "rank", store=False)
    wide = ranked.groupBy(entity).agg(*[F.max(F.when(F.col("factor") == c, F.col("rank"))).alias(f"r{i}") for i, c in enumerate(all_of)])
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.corr(f"r{i}", "r0").alias("rho"), F.count(F.lit(1)).alias("n"))
                      for i, c in enumerate(all_of) if i])
    return wide.agg(pairs.alias("_p")).select(F.inline("_p")).where(F.col("n") >= min_rows)


def topk_correlation(corr: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k strongest by absolute value, labelled by sign."""
    top = corr.orderBy(F.abs("rho").desc_nulls_last(), F.col("factor")).limit(k)
    return top.withColumn("sign", sign_label("rho")).orderBy("rho")


def ols_by_group(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Least-squares line per group: slope, intercept, R^2, n."""
    d = df.dropna(subset=[x, y]).where(F.col(group).isNotNull())
    return d.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def minmax_score(df: DataFrame, entity: str, metrics) -> DataFrame:
    """A26 (+U2 long form): per metric (x-min)/range for higher-is-better, else
    1-(x-min)/range (lower-is-better and unlisted); range 0 -> 0.5. Rows with
    any null metric are dropped first."""
    metrics = [m for m in metrics if m in df.columns]
    d = df.dropna(subset=metrics).select(entity, *metrics)
    long = d.unpivot([entity], metrics, "metric", "value")
    mm = long.groupBy("metric").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    j = join_small(long, mm, "metric", "inner")
    rng = F.col("_max") - F.col("_min")
    frac = (F.col("value") - F.col("_min")) / rng
    score = (F.when(rng == 0, F.lit(0.5))
             .when(F.col("metric").isin(*HIGHER_IS_BETTER), frac)
             .otherwise(F.lit(1.0) - frac))
    return j.select(entity, "metric", "value", score.alias("score"))
