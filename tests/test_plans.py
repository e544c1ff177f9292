"""Plan shape: stacked windows share one exchange, dropped features leave no
window behind, entity filters reach the scan side of windows."""
from panelkit.operators import filters as P
from panelkit.operators import windows as W
from panelkit.plans import etl as X
from panelkit.sources import fixtures as fx
from panelkit.spec import PanelSpec

SF = "/root/testdata/sf0.001"
SPEC = PanelSpec()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stacked_windows_one_exchange(spark):
    td = fx.stored(spark, SF, "type_day")
    df = W.lag_features(W.moving_average(td, SPEC, ["new_cases"]), SPEC, ["new_cases"])
    plan = _plan(df)
    assert plan.count("Exchange hashpartitioning") <= 1


def test_dropped_features_are_pruned(spark):
    td = fx.stored(spark, SF, "type_day")
    df = P.drop_intermediate(W.lag_features(W.moving_average(td, SPEC), SPEC))
    assert "Window" not in _plan(df)


def test_entity_filter_below_window(spark):
    td = fx.stored(spark, SF, "type_day")
    df = P.entity_eq(X.feature_pipeline(td, SPEC), SPEC, ["click"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the filter on the partition key is pushed beneath the Window operators
    assert plan.rfind("Filter") > plan.find("Window")
