"""Stored panels are Parquet scans: columns are pruned and predicates reach the scan; nothing is checkpointed row by row."""
from panelkit.operators import filters as P
from panelkit.plans import dashboard as D
from panelkit.plans import etl as X
from panelkit.session import clean_up
from panelkit.sources import fixtures as fx
from panelkit.spec import PanelSpec

SF = "/root/testdata/sf0.001"
SPEC = PanelSpec()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    td = fx.stored(spark, SF, "type_day")
    df = P.date_range(P.entity_eq(td, SPEC, ["click"]), SPEC, "2024-01-03", "2024-01-09").select("location", "date", "new_cases")
    plan = _plan(df)
    pushed = plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert "location" in pushed and "date" in pushed
    assert "population" not in plan.split("ReadSchema:")[1]


def test_kpi_strip_and_audit_use_one_aggregate_each(spark):
    nl = fx.stored(spark, SF, "nation_latest")
    assert _plan(D.kpi_strip(nl, SPEC)).count("FileScan") == 1
    assert _plan(D.pipeline_audit({"raw": nl, "again": nl})).count("FileScan") == 2


def test_cleaning_dedupes_once(spark):
    cl = X.clean_pipeline(fx.stored(spark, SF, "event_reports"), SPEC)
    assert "max_by" not in _plan(cl.df) and "FileScan parquet" in _plan(cl.df)


def test_clean_up_deletes_stored_tables(spark, tmp_path):
    from panelkit import session

    df = session.cut_lineage(spark.range(5))
    path = session._WRITTEN[-1].removeprefix("file:")
    assert df.count() == 5
    import os

    assert os.path.isdir(path)
    clean_up(spark)
    assert not os.path.exists(path) and fx._STORED == {}
