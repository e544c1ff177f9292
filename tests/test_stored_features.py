"""Key column, one-scan rollup, observed reports, bucketed table, numbered files and the one-result views."""
import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.operators import aggregates as A
from panelkit.operators import filters as P
from panelkit.operators import windows as W
from panelkit.operators.profile import metadata_document
from panelkit.plans import dashboard as D
from panelkit.plans import etl as X
from panelkit.sources import readers, sinks
from panelkit.spec import PanelSpec

SF = "/root/testdata/sf0.001"
SPEC = PanelSpec()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["entity_history", "entities_in", "compare_timeseries", "compare_nested", "latest_for",
                                 "recent_first", "entity_moving_average"])
def test_lookups_push_the_key_to_the_scan(spark, key):
    text = plan(catalog.QUERIES[key](spark, SF))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", text)
    assert pushed and all("_ekey" in p for p in pushed if "EqualTo" in p or "In(" in p) and any("_ekey,[" in p or "_ekey," in p for p in pushed)


def panel(spark, rows):
    return spark.createDataFrame(rows, "location string, iso_code string, continent string, date date, _ord long, new_cases double, "
                                       "population double, median_age double")


DAY = dt.date(2024, 1, 1)
ROWS = [("a", "A", "g", DAY, 1, 1.0, 10.0, 30.0), ("a", "A", "g", DAY + dt.timedelta(1), 2, None, 10.0, 30.0),
        ("b", "B", "g", DAY, 3, 5.0, 30.0, None), ("World", "W", "Global", DAY, 4, 99.0, 1.0, 1.0),
        ("Europe", "E", None, DAY, 5, 50.0, 1.0, 1.0), ("b", "B", "g", None, 6, 7.0, 40.0, None), (None, "n", "g", DAY, 7, 2.0, 5.0, 1.0)]


def test_rollup_scans_the_source_once_and_keeps_its_rules(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, ROWS).write.parquet(path)
    out = A.world_rollup(spark.read.parquet(path), SPEC)
    assert plan(out).count(f"{path}]") == 1 and "CartesianProduct" not in plan(out)
    world = {r["date"]: r for r in out.where("location = 'World'").collect()}
    assert {d: r["new_cases"] for d, r in world.items()} == {DAY: 8.0, DAY + dt.timedelta(1): 0.0}
    assert world[DAY]["population"] == 50.0 and world[DAY]["median_age"] == pytest.approx(300 / 50)
    only = A.world_rollup(spark.read.parquet(path), SPEC, weight_nonnull_only=True).where("location = 'World'").first()
    assert only["median_age"] == pytest.approx(30.0)
    assert out.where("continent is null").isEmpty() and out.count() == 5 + 2
    none = panel(spark, [r for r in ROWS if r[2] is None])
    assert A.world_rollup(none, SPEC).collect() == none.collect()


def test_rollup_aggregate_is_hashed(spark):
    text = plan(A.rollup_parts(panel(spark, ROWS), SPEC, ["new_cases"], ["median_age"]))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and text.count("Exchange") == 1


def test_reports_add_no_scan(spark):
    er = catalog._er(spark, SF)
    cleaned = X.clean_pipeline(er, SPEC)
    assert "Scan parquet" not in plan(cleaned.report()) and "FileScan" not in plan(cleaned.report())
    row = cleaned.report().first()
    assert row["duplicates_removed"] == er.count() - er.select("location", "date").distinct().count()
    assert row["outliers_handled"] == cleaned.flagged.agg(sum((F.coalesce(F.sum(c), F.lit(0)) for c in cleaned.flagged.columns if c.startswith(X.FLAG)), F.lit(0))).first()[0]
    imputed = X.impute_pipeline(cleaned.stored(), SPEC)
    assert "FileScan" not in plan(imputed.report()) and imputed.stored().columns == cleaned.df.columns
    assert sorted(map(str, cleaned.stored().collect())) == sorted(map(str, X.clean_pipeline(er, SPEC).df.collect()))


def test_reports_of_an_empty_panel(spark):
    empty = panel(spark, [])
    assert X.clean_pipeline(empty, SPEC).report().first().asDict() == {
        "duplicates_removed": 0, "columns_dropped": 0, "dropped_column_names": "", "outliers_handled": 0}
    assert set(X.impute_pipeline(empty, SPEC).report().first()) == {0}


def test_bucketed_table_needs_no_exchange(spark, tmp_path):
    td = catalog._td(spark, SF)
    t = sinks.materialize_bucketed(td, SPEC, "bucketed_panel", str(tmp_path / "t"), buckets=4)
    try:
        chain = W.days_since_first(W.first_difference(W.lag_features(W.growth_rate(W.running_total(W.moving_average(t, SPEC), SPEC), SPEC), SPEC), SPEC), SPEC)
        fills = W.cap_zscore(W.cap_iqr(W.fill_statistic(W.interpolate_bounded(W.zero_fill(W.forward_fill(W.static_fill(t, SPEC), SPEC), SPEC), SPEC), SPEC), SPEC), SPEC)
        for df in (chain, fills, W.centered_average(t, SPEC, ["new_cases"])):
            assert "Exchange" not in plan(df)
        assert sorted(map(str, t.collect())) == sorted(map(str, td.collect()))
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_panel")


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    lines = [f"e{i % 7},2024-01-0{1 + i % 5},{i}" for i in range(3_000)]
    for k, (a, b) in enumerate([(0, 1_000), (1_000, 1_010), (1_010, 3_000)]):
        folder = tmp_path / "csv"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{k}.csv").write_text("\n".join(["location,date,v", *lines[a:b]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files are cut into many splits
    try:
        df = readers.scan_csv(spark, str(tmp_path / "csv"), SPEC)
        assert df.rdd.getNumPartitions() > 5
        assert [r["v"] for r in df.orderBy("_ord").collect()] == [float(i) for i in range(3_000)]
        assert sorted(r["_ord"] for r in df.collect()) == list(range(3_000))
        last = {(r["location"], r["date"]): r["v"] for r in A.dedupe_last(df, SPEC).collect()}
        assert last == {(f"e{i % 7}", dt.date(2024, 1, 1 + i % 5)): float(i) for i in range(3_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_metadata_is_one_nested_object(spark, tmp_path):
    path = sinks.save_json(metadata_document(panel(spark, ROWS), SPEC, {"note": "x"}), str(tmp_path / "m"))
    text = [line for f in (tmp_path / "m").glob("*.json") for line in f.read_text().splitlines()]
    assert path and len(text) == 1
    m = json.loads(text[0])
    assert m["columns"][0] == "location" and m["date_range"] == {"start": "2024-01-01", "end": "2024-01-02"}
    assert m["data_types"]["date"] == "date" and m["custom"] == {"note": "x"} and (m["total_rows"], m["locations"]) == (7, 4)
    assert metadata_document(panel(spark, []), SPEC).first()["custom"] == {}


def test_period_view_is_one_scan(spark):
    view = catalog.QUERIES["period_view"](spark, SF)
    assert plan(view).count("FileScan") == 1 or plan(view).count("Scan parquet") == 1
    labels = spark.createDataFrame([], "metric string, label string")
    got = {r["location"]: r for r in D.period_view(panel(spark, ROWS), SPEC, ["new_cases", "no_such"], labels, "2024-01-01", "2024-01-01", ["A", "b"]).collect()}
    assert got["a"]["period_total"] == 1.0 and got["a"]["median_age"] == 30.0 and got["a"]["label"] == "New Cases"
    assert set(got) == {"a", "b"}


def test_factor_study_reads_the_source_once(spark, tmp_path):
    path = str(tmp_path / "latest")
    rows = [(f"e{i}", "x", "g" if i % 3 else "h", DAY, i, float(i * i % 97 - 20), 1.0, 1.0) for i in range(200)] + [("far", "x", "g", DAY, 900, 1e9, 1.0, 1.0)]
    panel(spark, rows).write.parquet(path)
    for log in (False, True):
        out = D.factor_study(spark.read.parquet(path), SPEC, "new_cases", log_scale=log)
        assert f"{path}]" not in plan(out)
        got = out.collect()
        n = {s: sum(r["count"] or 0 for r in got if r["section"] == s) for s in ("histogram",)}
        kept = [r[5] for r in rows if r[5] < 1e6 and (r[5] > 0 or not log)]
        assert n["histogram"] == len(kept)
        assert [r["value"] for r in got if r["section"] == "summary" and r["item"] == "n"] == [200.0]
        assert {r["label"] for r in got if r["section"] == "box"} == {"g", "h"}
    assert D.factor_study(panel(spark, []), SPEC, "new_cases").count() == 0
    below = panel(spark, [(f"e{i}", "x", "g", DAY, i, -1.0 - i, 1.0, 1.0) for i in range(9)])
    drawn = D.factor_study(below, SPEC, "new_cases", log_scale=True).where("section = 'histogram'").agg(F.sum("count")).first()[0]
    assert drawn == 9  # nothing is positive: all rows are drawn
