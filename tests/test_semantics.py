"""Hand-checked semantics of single operators (quirks of the surveyed system)."""
import datetime as dt

from pyspark.sql import functions as F

from panelkit.functions.scalar import format_big_number, label_fallback
from panelkit.operators import aggregates as A
from panelkit.operators import filters as P
from panelkit.operators import windows as W
from panelkit.plans import etl as X
from panelkit.spec import PanelSpec

SPEC = PanelSpec()
D = dt.date(2021, 1, 1)


def _df(spark, rows, extra="v double"):
    schema = f"location string, continent string, date date, _ord long, {extra}"
    return spark.createDataFrame(rows, schema)


def test_interpolation_gap_limits(spark):
    # knots at rows 1 and 17 (gap of 15 nulls): rows 9 (8 from each knot) stay null
    rows = [("A", "G", D + dt.timedelta(days=i), i, 0.0 if i == 0 else (16.0 if i == 16 else None)) for i in range(17)]
    got = {r["_ord"]: r["v"] for r in W.interpolate_bounded(_df(spark, rows), SPEC, ["v"]).collect()}
    assert got[7] == 7.0 and got[9] == 9.0
    assert got[8] is None
    # edges take the nearest knot within the limit
    rows = [("B", "G", D + dt.timedelta(days=i), i, 5.0 if i == 9 else None) for i in range(19)]
    got = {r["_ord"]: r["v"] for r in W.interpolate_bounded(_df(spark, rows), SPEC, ["v"]).collect()}
    assert got[2] == 5.0 and got[1] is None and got[16] == 5.0 and got[17] is None


def test_latest_first_tie_and_dedupe_last(spark):
    rows = [("A", "G", D, 3, 1.0), ("A", "G", D, 1, 2.0), ("A", "G", D - dt.timedelta(days=1), 9, 3.0)]
    df = _df(spark, rows)
    lat = A.latest_per_entity(df, SPEC).collect()
    assert [(r["_ord"], r["v"]) for r in lat] == [(1, 2.0)]  # latest date, first in source order
    dd = sorted((r["date"], r["_ord"]) for r in A.dedupe_last(df, SPEC).collect())
    assert dd == [(D - dt.timedelta(days=1), 9), (D, 3)]  # last in source order per (entity, date)


def test_world_rollup_weights_and_zero_sums(spark):
    rows = [("A", "G", D, 1, 10.0, None, 100.0, 2.0), ("B", "G", D, 2, None, None, 300.0, None),
            ("Agg", None, D, 3, 99.0, None, 999.0, 9.0)]
    df = spark.createDataFrame(rows, "location string, continent string, date date, _ord long, new_cases double, "
                                     "new_deaths double, population double, median_age double")
    df = df.withColumn("iso_code", F.lit("X"))
    w = [r for r in A.world_rollup(df, SPEC).collect() if r["location"] == "World"][0]
    assert w["new_cases"] == 10.0 and w["new_deaths"] == 0.0  # all-null sum is 0; aggregates dropped
    assert w["population"] == 400.0
    assert w["median_age"] == 200.0 / 400.0  # null statistic keeps its weight in the denominator
    assert w["continent"] == "Global" and w["iso_code"] == "OWID_WRL"


def test_prune_and_clamp(spark):
    rows = [("A", "G", D + dt.timedelta(days=i), i, -1.0 if i % 2 else 2.0, None if i < 3 else 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "location string, continent string, date date, _ord long, new_x double, odd double")
    assert P.null_ratio_columns(df) == ["odd"]
    cl = X.clean_numeric(df, SPEC)
    assert sorted(r["new_x"] for r in cl.collect()) == [0.0, 0.0, 2.0, 2.0]


def test_zero_iqr_flattens(spark):
    # Q1 = Q3 = 0 caps every positive value to 0 (faithful quirk)
    rows = [("A", "G", D + dt.timedelta(days=i), i, 5.0 if i == 0 else 0.0) for i in range(6)]
    got = [r["v"] for r in W.cap_iqr(_df(spark, rows), SPEC, ["v"]).collect()]
    assert got == [0.0] * 6


def test_format_big_number(spark):
    want = {2.5e9: "2.50 B", 2.5e12: "2500.00 B", 999999999.0: "1000.00 M", 3.25e6: "3.25 M", 999960.0: "1000.0 K", 12345.0: "12.3 K",
            7.25: "7.2", 0.25: "0.2", 0.35: "0.3", 8.85: "8.8", -0.75: "-0.8", 0.0: "0", 123.0: "123", -2500.0: "-2.5 K"}
    df = spark.createDataFrame([(v,) for v in [None, *want]], "x double")
    got = [r[0] for r in df.select(format_big_number("x")).collect()]
    assert got == ["N/A", *want.values()]


def test_label_fallback_is_title_case(spark):
    names = ["total_cases_per_million", "per_100k_x", "x-y_z", "gdp2_2x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(label_fallback("n")).collect()] == [n.replace("_", " ").title() for n in names]
