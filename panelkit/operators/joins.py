"""Join helpers and the implicit joins of the surveyed system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.spec import AGGREGATE_NAMES, PanelSpec

# A side is broadcast only when the optimizer's size estimate proves it small.
BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def plan_size_bytes(df: DataFrame) -> int:
    """Optimizer estimate of the plan's output size (no job is run).

    For scans it is the file size after column pruning; filters, projections
    and aggregates never grow it and joins multiply it, so it bounds the
    data from above.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join with ``small`` broadcast only if its size bound is below ``max_bytes``.

    Otherwise the plain join is kept and Spark plans a shuffle (sort-merge)
    join; AQE may still switch to a broadcast from the measured shuffle size.
    """
    side = F.broadcast(small) if plan_size_bytes(small) <= max_bytes else small
    return big.join(side, on, how)


def join_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row by construction).

    Planned as a nested-loop join with a broadcast side of one row, whatever
    the data: each row is read once.
    """
    return df.crossJoin(F.broadcast(one_row))


def null_safe_join(df: DataFrame, stats: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the columns of ``stats`` follow those of ``df``. Without keys ``stats`` is one row."""
    keys = list(keys or [])
    if not keys:
        return join_one_row(df, stats)
    other = stats.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in stats.columns])
    on = [df[c].eqNullSafe(other[f"_key_{c}"]) for c in keys]
    return df.join(other, on, how).drop(*[f"_key_{c}" for c in keys])


def group_stat_join(df: DataFrame, spec: PanelSpec, cols, stat: str = "median") -> DataFrame:
    """Per-entity statistic of many columns in one aggregation, joined back.

    One ``groupBy`` (partial + final aggregation) for all columns; the
    per-entity table is joined on the entity key.
    """
    E = spec.entity
    agg = {"median": lambda c: F.percentile(c, 0.5), "mean": F.avg,
           "min": F.min, "max": F.max, "sum": F.sum}[stat]
    stats = df.where(F.col(E).isNotNull()).groupBy(E).agg(
        *[agg(c).alias(f"{c}_{stat}") for c in cols])
    return df.join(stats, E, "left")


def metric_label_join(metrics: DataFrame, dictionary: DataFrame, name_col: str = "metric") -> DataFrame:
    """Dictionary lookup with fallback label (``_`` -> space, title case)."""
    from panelkit.functions.scalar import label_fallback

    j = join_small(metrics, dictionary, name_col, "left")
    return j.withColumn("label", F.coalesce(F.col("label"), label_fallback(F.col(name_col))))


def entity_semi(df: DataFrame, spec: PanelSpec, wanted: DataFrame, col: str = "name") -> DataFrame:
    """Keep rows whose lower-cased entity is in ``wanted`` (left semi join)."""
    w = wanted.select(F.lower(F.trim(F.col(col))).alias("_k")).where(F.col("_k") != "").distinct()
    key = F.col(spec.ekey) if spec.ekey in df.columns else F.lower(F.col(spec.entity))
    return join_small(df.withColumn("_k", key), w, "_k", "left_semi").drop("_k", spec.ekey)


def aggregate_anti(df: DataFrame, spec: PanelSpec, names=None) -> DataFrame:
    """Drop rows whose lower-cased entity is an aggregate name (left anti join).

    A null entity is kept, as a null never matches the list.
    """
    names = names or AGGREGATE_NAMES
    spark = df.sparkSession
    agg = spark.createDataFrame([(n,) for n in names], "_k string")
    return df.withColumn("_k", F.lower(F.col(spec.entity))).join(
        F.broadcast(agg), "_k", "left_anti").drop("_k")
