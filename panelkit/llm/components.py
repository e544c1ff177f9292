"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import scratch_path

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links (a, b): root is the smallest node of its component.

    Each round keeps at most as many links as before; a node's neighbours are
    only grouped to their minimum, never gathered. Rounds are written to the
    shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession

    def store(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path)

    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours hang on the node's minimum
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the node and its smaller neighbours hang on their minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = store(small.where("u <> v").distinct())
        key = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if key(new) == key(e):
            break
        e = new
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
