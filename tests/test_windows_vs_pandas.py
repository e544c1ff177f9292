"""Window operators against pandas twins on random null-bearing panels."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelkit.operators import windows as W
from panelkit.spec import PanelSpec

SPEC = PanelSpec()


def _panel(seed: int, n_ent: int = 4, n_days: int = 45) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n_ent):
        vals = rng.normal(100, 30, n_days).round(2)
        mask = np.zeros(n_days, bool)
        for _ in range(rng.integers(1, 5)):  # null runs of random length, some longer than 14
            a = rng.integers(0, n_days)
            mask[a:a + rng.integers(1, 20)] = True
        if e == 0:
            mask[:] = True  # an all-null entity
        tot = np.cumsum(rng.integers(0, 9, n_days)).astype(float)
        tmask = rng.random(n_days) < 0.3
        for d in range(n_days):
            rows.append({
                "location": f"E{e}", "continent": "G", "iso_code": f"E{e}",
                "date": dt.date(2021, 1, 1) + dt.timedelta(days=d), "_ord": d,
                "reproduction_rate": None if mask[d] else float(vals[d]),
                "total_cases": None if tmask[d] else float(tot[d]),
                "new_cases": None if mask[d] else float(abs(vals[d])),
            })
    return pd.DataFrame(rows)


def _spark_df(spark, pdf):
    cols = ["location", "continent", "iso_code", "date", "_ord", "reproduction_rate", "total_cases", "new_cases"]
    rows = [tuple(None if (isinstance(v, float) and np.isnan(v)) else v for v in r)
            for r in pdf[cols].astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "location string, continent string, iso_code string, date date, _ord long, "
                                       "reproduction_rate double, total_cases double, new_cases double")


def _to_pd(df, cols):
    out = df.select("location", "_ord", *cols).toPandas().sort_values(["location", "_ord"]).reset_index(drop=True)
    return out


def _close(a: pd.Series, b: pd.Series):
    a = a.astype(float).to_numpy()
    b = b.astype(float).to_numpy()
    assert np.array_equal(np.isnan(a), np.isnan(b)), "null pattern differs"
    m = ~np.isnan(a)
    assert np.allclose(a[m], b[m], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interpolate_bounded(spark, seed):
    pdf = _panel(seed)
    got = _to_pd(W.interpolate_bounded(_spark_df(spark, pdf), SPEC, ["reproduction_rate"]), ["reproduction_rate"])
    exp = pdf.sort_values(["location", "_ord"]).copy()
    exp["reproduction_rate"] = exp.groupby("location")["reproduction_rate"].transform(
        lambda x: x.interpolate(method="linear", limit_direction="both", limit=7))
    _close(got["reproduction_rate"], exp.reset_index(drop=True)["reproduction_rate"])


@pytest.mark.parametrize("seed", [4, 5])
def test_fills_and_running(spark, seed):
    pdf = _panel(seed)
    sdf = _spark_df(spark, pdf)
    exp = pdf.sort_values(["location", "_ord"]).reset_index(drop=True)
    g = exp.groupby("location")
    # W1 static fill
    got = _to_pd(W.static_fill(sdf, SPEC, ["reproduction_rate"]), ["reproduction_rate"])
    e1 = g["reproduction_rate"].ffill()
    e1 = e1.groupby(exp["location"]).bfill()
    _close(got["reproduction_rate"], e1)
    # W2 forward fill
    got = _to_pd(W.forward_fill(sdf, SPEC, ["total_cases"]), ["total_cases"])
    _close(got["total_cases"], g["total_cases"].ffill())
    # W8 moving average (min_periods 1)
    got = _to_pd(W.moving_average(sdf, SPEC, ["new_cases"], [7]), ["new_cases_ma7"])
    _close(got["new_cases_ma7"], g["new_cases"].transform(lambda x: x.rolling(7, min_periods=1).mean()))
    # W9 centred average
    got = _to_pd(W.centered_average(sdf, SPEC, ["new_cases"], 7), ["new_cases_avg_7"])
    _close(got["new_cases_avg_7"], g["new_cases"].transform(lambda x: x.rolling(7, center=True, min_periods=1).mean()))
    # W11 lag
    got = _to_pd(W.lag_features(sdf, SPEC, ["new_cases"], [7]), ["new_cases_lag7"])
    _close(got["new_cases_lag7"], g["new_cases"].shift(7))
    # W12 running total (null stays null, then 0)
    got = _to_pd(W.running_total(sdf.drop("total_cases"), SPEC, {"new_cases": "total_cases"}), ["total_cases"])
    _close(got["total_cases"], g["new_cases"].cumsum().fillna(0))
    # W10 growth rate: pct_change of the padded series, inf -> null, clipped
    got = _to_pd(W.growth_rate(sdf, SPEC, ["total_cases"]), ["total_cases_growth_rate"])
    ff = g["total_cases"].ffill()
    pct = (ff / ff.groupby(exp["location"]).shift(1) - 1) * 100
    pct = pct.replace([np.inf, -np.inf], np.nan).clip(-1000, 1000)
    _close(got["total_cases_growth_rate"], pct)
    # W5 median fill
    got = _to_pd(W.fill_statistic(sdf, SPEC, ["reproduction_rate"]), ["reproduction_rate"])
    _close(got["reproduction_rate"], g["reproduction_rate"].transform(lambda x: x.fillna(x.median())))


def test_cap_iqr_matches_pandas(spark):
    pdf = _panel(7)
    sdf = _spark_df(spark, pdf)
    got = _to_pd(W.cap_iqr(sdf, SPEC, ["reproduction_rate"], factor=0.5), ["reproduction_rate"])
    exp = pdf.sort_values(["location", "_ord"]).reset_index(drop=True)
    q1 = exp.groupby("location")["reproduction_rate"].transform("quantile", 0.25)
    q3 = exp.groupby("location")["reproduction_rate"].transform("quantile", 0.75)
    lo, hi = q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)
    v = exp["reproduction_rate"].copy()
    v[v < lo] = lo[v < lo]
    v[v > hi] = hi[v > hi]
    _close(got["reproduction_rate"], v)
