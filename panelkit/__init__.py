"""panelkit: a Spark-native engine for panel data (one row per entity and day).

Layout
  sources/    scans, sinks and the TESTDATA-derived panels
  functions/  column expressions (scalar functions)
  operators/  DataFrame -> DataFrame operators (filters, windows, aggregates, ...)
  plans/      composite pipelines (ETL, views, dashboard analytics)
"""

from panelkit.spec import PanelSpec

__all__ = ["PanelSpec"]
