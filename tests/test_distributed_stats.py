"""Ranks and quantiles: one distributed path, equal to pandas with ties, nulls, null keys and hot groups."""
import numpy as np
import pandas as pd
import pytest

from panelkit.operators import stats as S


@pytest.fixture()
def rows():
    rng = np.random.default_rng(11)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, 300)]  # many ties, a null key
    rows += [("tail", float(np.sign(x) * 10 ** abs(x))) for x in rng.normal(size=400) * 3]
    rows += [("near", 1e6 + i * 1e-9) for i in range(50)]  # all in one bin
    rows += [("hot", 7.0)] * 500 + [("a", None)] * 40 + [(None, None)] * 5 + [("empty", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles_equal_pandas(spark, rows):
    got = {(r["k"], r["p"]): r["q"] for r in S.quantiles(frame(spark, rows), ["k"], "v", PROBS).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).dropna(subset=["v"]).groupby("k", dropna=False)["v"].quantile(PROBS)
    want = {(None if k != k else k, p): q for (k, p), q in want.items()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12, abs=1e-12)


def test_quantiles_without_keys(spark, rows):
    got = S.quantile_columns(frame(spark, rows), [], "v", {"q1": 0.25, "m": 0.5}).collect()
    v = pd.Series([x for _, x in rows if x is not None])
    assert len(got) == 1 and got[0]["q1"] == pytest.approx(v.quantile(0.25)) and got[0]["m"] == pytest.approx(v.median())


@pytest.mark.parametrize("keys", [["k"], []])
def test_average_rank_equals_pandas(spark, rows, keys):
    got = S.average_rank(frame(spark, rows), keys, "v").select("k", "v", "rank").collect()
    p = pd.DataFrame(rows, columns=["k", "v"])
    p["rank"] = p.groupby("k", dropna=False)["v"].rank() if keys else p["v"].rank()
    key = lambda r: tuple("~" if x is None or x != x else f"{x:.12g}" if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, p.itertuples(index=False)))


def test_nulls_have_no_rank(spark):
    got = S.average_rank(spark.createDataFrame([(None,), (None,), (1.0,), (2.0,), (2.0,)], "v double"), [], "v").collect()
    assert sorted((r["rank"] for r in got), key=str) == [1.0, 2.5, 2.5, None, None]


def test_plan_reads_the_source_once(spark, rows, tmp_path):
    """The values are stored once; all that is built afterwards reads the narrow copy."""
    path = str(tmp_path / "source")
    frame(spark, rows).write.parquet(path)
    df = spark.read.parquet(path)
    plan = S.quantile_columns(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and "CartesianProduct" not in plan and "ObjectHash" not in plan
    rank = S.average_rank(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert rank.count(f"{path}]") == 1 and "_bin" in rank


def spread(spark, values, keys=()):
    """Rows of the fullest bin over all rows, and the number of bins in use."""
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    n = [r["_in"] for r in S.bin_offsets(S.binned(df, "v"), []).collect()]
    return max(n) / sum(n), len(n)


RNG = np.random.default_rng(5)
COLUMNS = {
    "large negatives": RNG.uniform(-6e7, -5e7, 5_000),
    "one huge negative": np.append(RNG.uniform(-6e7, -5e7, 4_000), [-1e8, -1e300]),
    "all negative": -np.exp(RNG.normal(size=3_000) * 6),
    "narrow beside outliers": np.concatenate([RNG.uniform(0, 0.2, 20_000), [1e12, -1e12, 5e12]]),
    "infinite": np.concatenate([RNG.normal(size=500), [np.inf, -np.inf, np.inf]]),
    "mixed signs": RNG.normal(size=3_000) * 10.0 ** RNG.integers(-8, 9, 3_000),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_hard_columns_equal_pandas_and_spread(spark, name):
    values = COLUMNS[name]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double").repartition(5)
    p = pd.Series(values)
    got = S.quantile_columns(df, [], "v", {f"q{i}": x for i, x in enumerate(PROBS)}).first()
    finite = np.isfinite(values).all()
    for i, x in enumerate(PROBS):
        if not finite and x in (0.0, 1.0):
            continue
        assert got[f"q{i}"] == pytest.approx(p.quantile(x), rel=1e-12, abs=1e-300)
    ranks = {r["i"]: r["rank"] for r in S.average_rank(df, [], "v").collect()}
    assert [ranks[i] for i in range(len(values))] == p.rank().tolist()
    share, bins = spread(spark, values)
    assert share <= 0.01 and bins > 100


def test_bins_hold_for_many_rows(spark):
    """200,000 values within 0.2 beside outliers of 1e12: over 100 bins, none above 1 %."""
    df = spark.range(200_000).selectExpr("CASE WHEN id % 50000 = 0 THEN 1e12 * (id - 90000) ELSE 0.2 * rand(3) END AS v")
    n = [r["_in"] for r in S.bin_offsets(S.binned(df, "v"), []).collect()]
    assert max(n) <= 2_000 and len(n) > 100


def test_box_outliers_equal_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", g, float(v)) for i, (g, v) in enumerate(zip(rng.choice(["a", "b"], 600), rng.standard_cauchy(600)))]
    rows += [("x", None, 1e9), ("y", "a", None)]
    df = spark.createDataFrame(rows, "entity string, grp string, v double")
    p = pd.DataFrame(rows, columns=["entity", "grp", "v"]).dropna()
    q = p.groupby("grp")["v"].quantile([0.25, 0.75]).unstack()
    lo, hi = q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])
    out = p[(p["v"] < p["grp"].map(lo)) | (p["v"] > p["grp"].map(hi))]
    got = S.box_outliers(df, "entity", "v", "grp").collect()
    assert {r["entity"] for r in got} == set(out["entity"]) and len(got) == len(out)
    assert all((r["side"] == "high") == (r["v"] > 0) for r in got)
    box = {r["grp"]: r for r in S.box_stats(df, "v", "grp").collect()}
    for g in ("a", "b"):
        assert box[g]["q1"] == pytest.approx(q[0.25][g]) and box[g]["outliers"] == (out["grp"] == g).sum()


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)) - 1e6
    x[:, 1] = np.round(x[:, 0] * 3) + rng.integers(0, 4, 400)
    rows = [(f"e{i}", *map(float, r)) for i, r in enumerate(x)] + [("n", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "entity string, y double, a double, b double")
    got = {r["factor"]: r["rho"] for r in S.spearman(df, "entity", "y", ["a", "b", "missing"]).collect()}
    want = pd.DataFrame(x, columns=["y", "a", "b"]).corr("spearman")["y"]
    assert got.keys() == {"a", "b"} and all(got[c] == pytest.approx(want[c]) for c in got)
    assert S.spearman(df.limit(5), "entity", "y", ["a"]).count() == 0
