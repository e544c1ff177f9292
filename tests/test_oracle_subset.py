"""Registered queries vs their DuckDB twins on sf0.001 (a representative subset;
tools/check_oracle.py runs all of them)."""
import datetime as dt
import decimal
import math

import duckdb
import pytest

from panelkit.catalog import registered
from panelkit.oracle import oracle_sql

SF = "/root/testdata/sf0.001"
KEYS = ["interpolate_bounded", "impute_pipeline", "clean_pipeline", "feature_pipeline", "world_rollup",
        "latest_per_entity", "dedupe_last", "compare_timeseries", "spearman", "box_stats", "column_profile",
        "minmax_score", "cleaning_report", "imputation_report", "group_rollup_share", "global_kpis"]
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = registered()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = con.execute(oracle_sql()[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=lambda i: names[i])
    exp = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=_key)
    assert got == exp
