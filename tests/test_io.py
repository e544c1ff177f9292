"""Sources and sinks: round trips through the shared checkpoint folder."""
import os

from pyspark.sql import functions as F

from panelkit.session import scratch_path
from panelkit.sources import readers, sinks
from panelkit.sources.fixtures import stored
from panelkit.spec import PanelSpec

SF = "/root/testdata/sf0.001"
SPEC = PanelSpec()


def test_partitioned_sink_one_folder_per_entity(spark):
    td = stored(spark, SF, "type_day")
    path = sinks.save_by_entity(td.withColumn("location", F.concat(F.lit("a b/"), "location")), SPEC,
                                scratch_path(spark, "t_by_entity"), fmt="csv")
    local = path[len("file:"):] if path.startswith("file:") else path
    parts = sorted(d for d in os.listdir(local) if d.startswith(sinks.PART_COL + "="))
    assert len(parts) == td.select("location").distinct().count()
    assert all(" " not in p and "/" not in p.split("=", 1)[1] for p in parts)


def test_csv_scan_types_and_ordinal(spark):
    nd = stored(spark, SF, "nation_day")
    p = sinks.save_csv(nd, scratch_path(spark, "t_csv"))
    back = readers.scan_csv(spark, p, SPEC, add_ord=False)
    types = dict(back.dtypes)
    assert types["date"] == "date" and types["_ord"] == "bigint" and types["new_cases"] == "double"
    assert back.count() == nd.count()


def test_save_all_formats(spark):
    ud = stored(spark, SF, "user_day")
    out = sinks.save_all_formats(ud, SPEC, scratch_path(spark, "t_all"), "panel")
    assert set(out) == {"csv", "parquet", "json", "metadata", "statistics"}
    assert spark.read.parquet(out["parquet"]).count() == ud.count()
    meta = spark.read.json(out["metadata"]).first()
    assert meta["total_rows"] == ud.count() and meta["total_columns"] == len(ud.columns)
