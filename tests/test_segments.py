"""Segmented operators: equal to the plain windows and to pandas, with one entity that holds half of all rows."""
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import segments as G
from panelkit.operators import windows as W
from panelkit.spec import PanelSpec

SPEC = PanelSpec()
SCHEMA = "location string, iso_code string, continent string, date date, _ord long, new_cases double, total_x double, population double, level double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    day = dt.date(2020, 1, 1)
    out = []
    for e, n in [("hot", 600), ("a", 200), ("b", 190), ("c", 150), ("one", 1), ("empty", 30)]:
        gap = 0
        for i in range(n):
            gap = r.randint(5, 40) if r.random() < 0.04 else max(0, gap - 1)
            known = lambda p: gap == 0 and e != "empty" and r.random() < p
            out.append((e, e, "g", day + dt.timedelta(days=i if e == "hot" else i * r.choice([1, 1, 2])) , i,
                        float(r.randint(0, 50)) if known(0.9) else None, float(i * 3) if known(0.5) else None,
                        7.0 if known(0.2) else None, r.gauss(0, 3) if known(0.8) else None))
    out += [(None, "n", "g", day, 1, 1.0, 2.0, 3.0, 4.0), ("a", "a", "g", None, 900, 4.0, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


OPERATORS = {
    "static_fill": lambda m, d, k: m.static_fill(d, SPEC, ["population"], **k),
    "forward_fill": lambda m, d, k: m.forward_fill(d, SPEC, ["total_x"], **k),
    "running_total": lambda m, d, k: m.running_total(d, SPEC, {"new_cases": "sum_cases"}, **k),
    "moving_average": lambda m, d, k: m.moving_average(d, SPEC, ["new_cases", "level"], (1, 7, 14), **k),
    "interpolate_bounded": lambda m, d, k: m.interpolate_bounded(d, SPEC, ["total_x", "level"], **k),
    "fill_median": lambda m, d, k: m.fill_statistic(d, SPEC, ["level", "total_x"]),
    "fill_mean": lambda m, d, k: m.fill_statistic(d, SPEC, ["level"], method="mean"),
    "cap_iqr": lambda m, d, k: m.cap_iqr(d, SPEC, ["level", "new_cases"], factor=0.5),
}


def table(df):
    key = lambda r: [(x is None, f"{x:.9g}" if isinstance(x, float) else str(x)) for x in r]
    return df.columns, sorted((key(r) for r in df.collect()))


@pytest.mark.parametrize("rows_a_segment", [25, 400, 1_000_000])
@pytest.mark.parametrize("name", OPERATORS)
def test_equal_to_plain_windows(panel, name, rows_a_segment):
    if rows_a_segment != 25 and name in ("fill_median", "fill_mean", "cap_iqr"):
        pytest.skip("not segmented")
    assert table(OPERATORS[name](G, panel, {"rows": rows_a_segment})) == table(OPERATORS[name](W, panel, {}))


def test_equal_to_pandas(panel, rows):
    p = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    p = p[p["location"].notna() & p["date"].notna()].sort_values(["location", "date", "_ord"])
    g = p.groupby("location")
    want = {"total_x": g["total_x"].ffill(), "ma": g["new_cases"].transform(lambda s: s.rolling(7, min_periods=1).mean()),
            "sum": g["new_cases"].cumsum().fillna(0.0)}
    k = {"rows": 30}
    d = G.moving_average(G.running_total(G.forward_fill(panel, SPEC, ["total_x"], **k), SPEC, {"new_cases": "sum"}, **k), SPEC, ["new_cases"], (7,), **k)
    got = d.where("location is not null and date is not null").toPandas().sort_values(["location", "date", "_ord"])
    for a, b in (("total_x", "total_x"), ("sum", "sum"), ("new_cases_ma7", "ma")):
        pd.testing.assert_series_equal(got[a].reset_index(drop=True), want[b].reset_index(drop=True), check_names=False)


def test_a_huge_entity_lies_in_many_segments(panel):
    n = {(r["location"], r["_seg"]): r["n"] for r in
         G.with_segments(panel, SPEC, 60).groupBy("location", "_seg").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = [v for (e, _), v in n.items() if e == "hot"]
    assert len(hot) >= 5 and max(hot) <= 150


def test_one_partitioning_serves_window_summary_and_join(panel):
    plan = G.forward_fill(panel, SPEC, ["total_x"], rows=50)._jdf.queryExecution().executedPlan().toString()
    by_entity = [x for x in plan.splitlines() if "Exchange hashpartitioning(location#" in x and "_seg" not in x.split("]")[0]]
    assert len(by_entity) <= 1  # only the segment summaries are dealt by entity alone
