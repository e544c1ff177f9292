"""Independent SQL twins (DuckDB dialect) of the registered queries.

Each twin rebuilds its panel from the base tables with plain SQL and applies
the operator's definition directly (windows, quantiles, joins), so a match
means the Spark plan and the written definition agree. Double outputs are
rounded to 6 decimals like the Spark side.
"""

from __future__ import annotations

import json
import os

from panelkit.spec import AGGREGATE_NAMES, HIGHER_IS_BETTER

_DOUBLES = json.load(open(os.path.join(os.path.dirname(__file__), "oracle_doubles.json")))

ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
NEXT = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
EPOCH = "DATE '1970-01-01'"


def XS(c: str) -> str:
    """Exact sum of a 2-decimal column, as double."""
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def XA(c: str) -> str:
    """Exact mean of a 2-decimal column: exact sum / count."""
    return f"(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}))"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


AGG_LIST = _lit_list(AGGREGATE_NAMES)

# ---------------------------------------------------------------- panels

UD_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths", "new_tests",
           "total_cases", "total_deaths", "people_vaccinated", "reproduction_rate", "stringency_index",
           "icu_patients", "population", "gdp_per_capita"]
TD_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths", "new_tests",
           "total_cases", "total_deaths", "total_tests", "reproduction_rate", "stringency_index", "population"]
ND_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths", "new_tests",
           "new_vaccinations", "population", "gdp_per_capita", "life_expectancy", "extreme_poverty",
           "population_density", "median_age", "total_cases", "total_deaths", "total_tests"]
NL_COLS = ND_COLS + ["total_cases_per_million", "total_deaths_per_million", "total_tests_per_thousand",
                     "case_fatality_rate"]
ER_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths", "positive_rate",
           "icu_patients", "hosp_patients", "population"]

USER_DAY = f"""
ev AS (SELECT event_id, CAST(ts AS DATE) AS day, user_id, event_type, value FROM events),
ud_daily AS (SELECT user_id, day, CAST(count(*) AS DOUBLE) AS _n,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS _np,
    {XS('value')} AS _v, {XA('value')} AS _a, max(value) AS _mx,
    {XS("CASE WHEN event_type = 'purchase' THEN value END")} AS _pv,
    {XS("CASE WHEN event_type = 'error' THEN value END")} AS _ev
  FROM ev GROUP BY user_id, day),
ud_users AS (SELECT user_id, min(day) AS _d0, max(day) AS _d1, arg_min(event_type, event_id) AS continent,
    CAST(count(*) AS DOUBLE) AS _pop, {XA('value')} AS _gdp FROM ev GROUP BY user_id),
ud_grid AS (SELECT user_id, continent, _pop, _gdp,
    CAST(unnest(generate_series(CAST(_d0 AS TIMESTAMP), CAST(_d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM ud_users),
ud_j AS (SELECT g.user_id, g.continent, g._pop, g._gdp, g.day, d._n, d._np, d._v, d._a, d._mx, d._pv, d._ev
  FROM ud_grid g LEFT JOIN ud_daily d ON g.user_id = d.user_id AND g.day = d.day),
user_day AS (SELECT CAST(user_id AS VARCHAR) AS location, 'U' || CAST(user_id AS VARCHAR) AS iso_code, continent,
    day AS date, CAST(day - {EPOCH} AS BIGINT) AS _ord,
    _n AS new_cases, _np AS new_deaths, _v AS new_tests,
    CASE WHEN _n IS NOT NULL THEN sum(_n) OVER (PARTITION BY user_id ORDER BY day {ROWS}) END AS total_cases,
    CASE WHEN _np > 0 THEN sum(_np) OVER (PARTITION BY user_id ORDER BY day {ROWS}) END AS total_deaths,
    CASE WHEN _np > 0 THEN CAST(sum(CAST(_pv AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY day {ROWS}) AS DOUBLE) END AS people_vaccinated,
    _a AS reproduction_rate, _mx AS stringency_index, _ev AS icu_patients,
    CASE WHEN _n IS NOT NULL THEN _pop END AS population,
    CASE WHEN _np > 0 THEN _gdp END AS gdp_per_capita
  FROM ud_j)"""

TYPE_DAY = f"""
td0 AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS new_cases,
    CAST(count(DISTINCT user_id) AS DOUBLE) AS new_deaths, {XS('value')} AS new_tests,
    {XA('value')} AS reproduction_rate, max(value) AS stringency_index
  FROM events GROUP BY 1, 2),
type_day AS (SELECT event_type AS location, upper(substr(event_type, 1, 3)) AS iso_code,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'conversion' ELSE 'engagement' END AS continent,
    day AS date, CAST(day - {EPOCH} AS BIGINT) AS _ord, new_cases, new_deaths, new_tests,
    sum(new_cases) OVER (PARTITION BY event_type ORDER BY day {ROWS}) AS total_cases,
    sum(new_deaths) OVER (PARTITION BY event_type ORDER BY day {ROWS}) AS total_deaths,
    CAST(sum(CAST(new_tests AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY day {ROWS}) AS DOUBLE) AS total_tests,
    reproduction_rate, stringency_index,
    sum(new_cases) OVER (PARTITION BY event_type) AS population
  FROM td0)"""

_ND_SEL = ", ".join(ND_COLS[:15])


def _stat_ctes(level: str, tag: str) -> str:
    return f"""
stc_{tag} AS (SELECT {level}, CAST(count(*) AS DOUBLE) AS population, {XA('c_acctbal')} AS gdp_per_capita,
    {XA("CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END")} AS life_expectancy,
    avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) * 100 AS extreme_poverty
  FROM cn GROUP BY 1),
sts_{tag} AS (SELECT {level}, CAST(count(*) AS DOUBLE) AS population_density, {XA('s_acctbal')} AS median_age
  FROM sn GROUP BY 1),
st_{tag} AS (SELECT c.*, s.population_density, s.median_age FROM stc_{tag} c LEFT JOIN sts_{tag} s USING ({level}))"""


NATION = f"""
cn AS (SELECT c_custkey, n_nationkey, n_name, r_name, c_acctbal, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sn AS (SELECT s_acctbal, n_name, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
od AS (SELECT n_nationkey, n_name, r_name, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS new_cases,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS new_deaths,
    {XS('o_totalprice')} AS new_tests, {XS('c_acctbal')} AS new_vaccinations
  FROM orders JOIN cn ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
{_stat_ctes('n_name', 'n')},
{_stat_ctes('r_name', 'r')},
nd0 AS (SELECT n_name AS location, printf('N%02d', n_nationkey) AS iso_code, r_name AS continent, day AS date,
    CAST(day - {EPOCH} AS BIGINT) AS _ord, new_cases, new_deaths, new_tests, new_vaccinations,
    population, gdp_per_capita, life_expectancy, extreme_poverty, population_density, median_age
  FROM od LEFT JOIN st_n USING (n_name)),
rd_sum AS (SELECT r_name, day, sum(new_cases) AS new_cases, sum(new_deaths) AS new_deaths,
    {XS('new_tests')} AS new_tests, {XS('new_vaccinations')} AS new_vaccinations FROM od GROUP BY 1, 2),
rd0 AS (SELECT r_name AS location, 'OWID_' || upper(substr(r_name, 1, 3)) AS iso_code,
    CAST(NULL AS VARCHAR) AS continent, day AS date, CAST(day - {EPOCH} AS BIGINT) AS _ord,
    new_cases, new_deaths, new_tests, new_vaccinations,
    population, gdp_per_capita, life_expectancy, extreme_poverty, population_density, median_age
  FROM rd_sum LEFT JOIN st_r USING (r_name)),
nation_day AS (SELECT {_ND_SEL},
    sum(new_cases) OVER (PARTITION BY location ORDER BY date {ROWS}) AS total_cases,
    sum(new_deaths) OVER (PARTITION BY location ORDER BY date {ROWS}) AS total_deaths,
    CAST(sum(CAST(new_tests AS DECIMAL(18,2))) OVER (PARTITION BY location ORDER BY date {ROWS}) AS DOUBLE) AS total_tests FROM nd0),
region_day AS (SELECT {_ND_SEL},
    sum(new_cases) OVER (PARTITION BY location ORDER BY date {ROWS}) AS total_cases,
    sum(new_deaths) OVER (PARTITION BY location ORDER BY date {ROWS}) AS total_deaths,
    CAST(sum(CAST(new_tests AS DECIMAL(18,2))) OVER (PARTITION BY location ORDER BY date {ROWS}) AS DOUBLE) AS total_tests FROM rd0),
nation_raw AS (SELECT * FROM nation_day UNION ALL SELECT * FROM region_day),
nl0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date DESC, _ord ASC) AS _rn
  FROM nation_raw WHERE location IS NOT NULL AND date IS NOT NULL) WHERE _rn = 1),
nation_latest AS (SELECT {", ".join(ND_COLS)},
    total_cases / nullif(population, 0) * 1000000.0 AS total_cases_per_million,
    total_deaths / nullif(population, 0) * 1000000.0 AS total_deaths_per_million,
    total_tests / nullif(population, 0) * 1000.0 AS total_tests_per_thousand,
    total_deaths / nullif(total_cases, 0) * 100.0 AS case_fatality_rate
  FROM nl0)"""

EVENT_REPORTS = """
er_raw AS (SELECT CAST(user_id AS VARCHAR) AS location, 'U' || CAST(user_id AS VARCHAR) AS iso_code,
    event_type AS continent,
    CASE WHEN TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) >= 90
         THEN '2024-01-' || regexp_extract(props, '(\\d+)', 1) ELSE strftime(ts, '%Y-%m-%d') END AS date,
    event_id AS _ord, value AS new_cases, value - 100.0 AS new_deaths, CASE WHEN value > 480 THEN value * 1e308 ELSE value END AS positive_rate,
    CASE WHEN event_type = 'error' THEN value END AS icu_patients, value AS hosp_patients, 1.0 AS population
  FROM events),
er AS (SELECT * REPLACE (TRY_CAST(date AS DATE) AS date) FROM er_raw)"""


def _with(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip().rstrip(",") for b in blocks)


def sig_round(c: str) -> str:
    """12 significant digits (same arithmetic as the Spark side)."""
    d = f"least(22, 11 - CAST(floor(log10(abs({c}))) AS BIGINT))"
    return (f"CASE WHEN {c} IS NULL OR isinf({c}) OR isnan({c}) OR {c} = 0 THEN {c} "
            f"WHEN {d} >= 0 THEN round({c} * pow(10, {d})) / pow(10, {d}) "
            f"ELSE round({c} / pow(10, -{d})) * pow(10, -{d}) END")


def _wrap(key: str, sql: str) -> str:
    """Round the query's double columns as the Spark side does."""
    dbl = _DOUBLES.get(key, [])
    if not dbl:
        return sql
    rep = ", ".join(f"{sig_round(_q(c))} AS {_q(c)}" for c in dbl)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _t"


# ---------------------------------------------------------------- SQL forms of the operators

def _wt(extra: str = "") -> str:
    return f"PARTITION BY location ORDER BY date, _ord {extra}"


def static_fill_sql(src: str, cols) -> str:
    return ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}), "
        f"first_value({c} IGNORE NULLS) OVER ({_wt(WHOLE)})) AS {c}" for c in cols)


def ffill_sql(cols) -> str:
    return ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS {c}" for c in cols)


def interp_ctes(src: str, out: str, all_cols, cols, limit: int = 7) -> str:
    """Bounded bidirectional linear interpolation by row position."""
    keep = [c for c in all_cols if c not in cols]
    knots = ", ".join(
        f"max(CASE WHEN {c} IS NOT NULL THEN _n END) OVER ({_wt(ROWS)}) AS _pn_{c}, "
        f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS _pv_{c}, "
        f"min(CASE WHEN {c} IS NOT NULL THEN _n END) OVER ({_wt(NEXT)}) AS _qn_{c}, "
        f"first_value({c} IGNORE NULLS) OVER ({_wt(NEXT)}) AS _qv_{c}" for c in cols)
    vals = []
    for c in cols:
        pn, pv, qn, qv = f"_pn_{c}", f"_pv_{c}", f"_qn_{c}", f"_qv_{c}"
        vals.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} "
            f"WHEN {pn} IS NOT NULL AND {qn} IS NOT NULL AND (_n - {pn} <= {limit} OR {qn} - _n <= {limit}) "
            f"THEN ({qv} - {pv}) / ({qn} - {pn}) * (_n - {pn}) + {pv} "
            f"WHEN {pn} IS NULL AND {qn} IS NOT NULL AND {qn} - _n <= {limit} THEN {qv} "
            f"WHEN {qn} IS NULL AND {pn} IS NOT NULL AND _n - {pn} <= {limit} THEN {pv} END AS {c}")
    return (f"{out}_n AS (SELECT *, row_number() OVER ({_wt()}) AS _n FROM {src}),\n"
            f"{out}_k AS (SELECT *, {knots} FROM {out}_n),\n"
            f"{out} AS (SELECT {', '.join(keep)}, {', '.join(vals)} FROM {out}_k)")


def median_fill_sql(cols, method: str = "median") -> str:
    f = "quantile_cont({c}, 0.5)" if method == "median" else "avg({c})"
    return ", ".join(f"coalesce({c}, {f.format(c=c)} OVER (PARTITION BY location)) AS {c}" for c in cols)


def _sel(cols, repl: dict) -> str:
    return ", ".join(repl.get(c, c) if c in repl else c for c in cols)


# user_day column roles (name rules applied to its schema)
UD_STATIC = ["population", "gdp_per_capita"]
UD_FFILL = ["total_cases", "total_deaths"]
UD_NEW = ["new_cases", "new_deaths", "new_tests"]
UD_INTERP = ["total_cases", "total_deaths", "people_vaccinated", "reproduction_rate", "stringency_index", "icu_patients"]
UD_STAT = UD_NEW + UD_INTERP


def impute_ctes(src: str, cols, static, ffill, new, interp, stat, tag: str = "im", method: str = "median") -> str:
    """W1 -> W2 -> W3 -> W4 -> W5 as a chain of CTEs ending in ``{tag}5``."""
    parts = [f"{tag}1 AS (SELECT " + ", ".join(
        c if c not in static else
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}), first_value({c} IGNORE NULLS) OVER ({_wt(WHOLE)})) AS {c}"
        for c in cols) + f" FROM {src})"]
    parts.append(f"{tag}2 AS (SELECT " + ", ".join(
        c if c not in ffill else f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS {c}" for c in cols)
        + f" FROM {tag}1)")
    parts.append(f"{tag}3 AS (SELECT " + ", ".join(
        c if c not in new else f"coalesce({c}, 0.0) AS {c}" for c in cols) + f" FROM {tag}2)")
    parts.append(interp_ctes(f"{tag}3", f"{tag}4", cols, interp))
    stat_f = "quantile_cont({c}, 0.5)" if method == "median" else "avg({c})"
    parts.append(f"{tag}5 AS (SELECT " + ", ".join(
        c if c not in stat else f"coalesce({c}, {stat_f.format(c=c)} OVER (PARTITION BY location)) AS {c}"
        for c in cols) + f" FROM {tag}4)")
    return ",\n".join(parts)


def cap_iqr_sql(cols, targets, factor: float = 3.0) -> str:
    out = []
    for c in cols:
        if c not in targets:
            out.append(c)
            continue
        q1 = f"quantile_cont({c}, 0.25) OVER (PARTITION BY location)"
        q3 = f"quantile_cont({c}, 0.75) OVER (PARTITION BY location)"
        lo = f"({q1} - {factor} * ({q3} - {q1}))"
        hi = f"({q3} + {factor} * ({q3} - {q1}))"
        out.append(f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}")
    return ", ".join(out)


def iqr_flags_sql(targets, factor: float = 3.0) -> str:
    parts = []
    for c in targets:
        q1 = f"quantile_cont({c}, 0.25) OVER (PARTITION BY location)"
        q3 = f"quantile_cont({c}, 0.75) OVER (PARTITION BY location)"
        parts.append(f"CASE WHEN {c} < ({q1} - {factor} * ({q3} - {q1})) OR {c} > ({q3} + {factor} * ({q3} - {q1})) THEN 1 ELSE 0 END")
    return " + ".join(parts)


def _inf_null(c: str) -> str:
    return f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END"


def _clamp(x: str) -> str:
    return f"CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({x}) END"


# event_reports cleaning: icu_patients is dropped by the null-ratio rule
ER_CLEAN_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths",
                 "positive_rate", "hosp_patients", "population"]
ER_CAP = ["new_cases", "new_deaths", "positive_rate", "hosp_patients"]
ER_CLEAN = f"""
cl_dd AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY location, date ORDER BY _ord DESC) AS _rn FROM er) WHERE _rn = 1),
cl_nd AS (SELECT {", ".join(ER_CLEAN_COLS)} FROM cl_dd WHERE date IS NOT NULL),
cl_num AS (SELECT location, iso_code, continent, date, _ord,
    {_clamp(_inf_null('new_cases'))} AS new_cases, {_clamp(_inf_null('new_deaths'))} AS new_deaths,
    {_inf_null('positive_rate')} AS positive_rate, {_clamp(_inf_null('hosp_patients'))} AS hosp_patients,
    {_clamp(_inf_null('population'))} AS population FROM cl_nd),
cleaned AS (SELECT {cap_iqr_sql(ER_CLEAN_COLS, ER_CAP)} FROM cl_num)"""

# user_day cleaning (pipeline audit): four sparse columns are dropped by the null-ratio rule
UD_CLEAN_COLS = ["location", "iso_code", "continent", "date", "_ord", "new_cases", "new_deaths", "new_tests",
                 "total_cases", "reproduction_rate", "stringency_index", "population"]
UD_CLEAN_CAP = ["new_cases", "new_deaths", "new_tests", "total_cases", "reproduction_rate", "stringency_index"]
UD_CLEAN = f"""
ucl_num AS (SELECT location, iso_code, continent, date, _ord,
    {_clamp(_inf_null('new_cases'))} AS new_cases, {_clamp(_inf_null('new_deaths'))} AS new_deaths,
    {_clamp(_inf_null('new_tests'))} AS new_tests, {_clamp(_inf_null('total_cases'))} AS total_cases,
    {_inf_null('reproduction_rate')} AS reproduction_rate, {_inf_null('stringency_index')} AS stringency_index,
    {_clamp(_inf_null('population'))} AS population FROM user_day WHERE date IS NOT NULL),
ucleaned AS (SELECT {cap_iqr_sql(UD_CLEAN_COLS, UD_CLEAN_CAP)} FROM ucl_num)"""


def null_counts_sql(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({_q(c)}) AS BIGINT) AS nulls FROM {src}" for c in cols)


def _ud_impute(src: str = "user_day", tag: str = "im", method: str = "median") -> str:
    return impute_ctes(src, UD_COLS, UD_STATIC, UD_FFILL, UD_NEW, UD_INTERP, UD_STAT, tag, method)


def _ranked_avg(src: str, part: str, val: str) -> str:
    return (f"rank() OVER (PARTITION BY {part} ORDER BY {val}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {val}) - 1) / 2.0")


def _trimmed(src: str, metric: str, out: str, cols: str = "location, continent") -> str:
    """P7 + dropna + 1.5*IQR trim of a cross-section column."""
    return f"""
{out}_base AS (SELECT {cols}, {metric} FROM {src}
  WHERE coalesce(lower(location) NOT IN ({AGG_LIST}), true) AND {metric} IS NOT NULL),
{out}_st AS (SELECT count(*) AS _n, quantile_cont({metric}, 0.25) AS _q1, quantile_cont({metric}, 0.75) AS _q3 FROM {out}_base),
{out} AS (SELECT b.* FROM {out}_base b, {out}_st s WHERE s._n <= 1 OR (
  b.{metric} >= s._q1 - 1.5 * CASE WHEN s._q3 - s._q1 > 0 THEN s._q3 - s._q1 ELSE 1.0 END AND
  b.{metric} <= s._q3 + 1.5 * CASE WHEN s._q3 - s._q1 > 0 THEN s._q3 - s._q1 ELSE 1.0 END))"""


NOT_AGG = f"coalesce(lower(location) NOT IN ({AGG_LIST}), true)"
SCORE_ENTITIES = ["NATION_0", "NATION_3", "NATION_5", "NATION_8", "NATION_11", "NATION_14", "NATION_20", "EUROPE"]
SCORE_METRICS = ["total_cases_per_million", "total_deaths_per_million", "gdp_per_capita", "median_age"]
FACTORS = ["population_density", "median_age", "gdp_per_capita", "extreme_poverty", "life_expectancy"]
OUTCOME = "total_deaths_per_million"


def _world_rollup() -> str:
    sums = ["total_cases", "new_cases", "total_deaths", "new_deaths", "total_tests", "new_tests", "new_vaccinations"]
    wcols = ["median_age", "gdp_per_capita", "extreme_poverty", "life_expectancy"]
    s = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {c}" for c in sums)
    w = ", ".join(f"CASE WHEN sum(population) > 0 THEN coalesce(sum({c} * population), 0.0) / sum(population) END AS {c}"
                  for c in wcols)
    return f"""
ctry AS (SELECT * FROM nation_raw WHERE continent IS NOT NULL AND location IS DISTINCT FROM 'World'),
w_date AS (SELECT date, {s} FROM ctry WHERE date IS NOT NULL GROUP BY date),
w_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY _ord DESC) AS _rn FROM ctry) WHERE _rn = 1),
w_stat AS (SELECT CAST(coalesce(sum(population), 0) AS DOUBLE) AS population, {w} FROM w_last),
w_rows AS (SELECT 'World' AS location, 'OWID_WRL' AS iso_code, 'Global' AS continent, d.date, CAST(0 AS BIGINT) AS _ord,
    d.new_cases, d.new_deaths, d.new_tests, d.new_vaccinations, s.population, s.gdp_per_capita, s.life_expectancy,
    s.extreme_poverty, CAST(NULL AS DOUBLE) AS population_density, s.median_age, d.total_cases, d.total_deaths, d.total_tests
  FROM w_date d, w_stat s),
rolled AS (SELECT * FROM ctry UNION ALL SELECT * FROM w_rows)"""


def _sql() -> dict[str, str]:
    U, T, N, E = USER_DAY, TYPE_DAY, NATION, EVENT_REPORTS
    ud, td, nd, nl, nr = (", ".join(UD_COLS), ", ".join(TD_COLS), ", ".join(ND_COLS),
                          ", ".join(NL_COLS), ", ".join(ND_COLS))
    q: dict[str, str] = {}

    # sources / sinks (round trips return the panel written)
    q["scan_csv"] = f"{_with(N)} SELECT {nd} FROM nation_day"
    q["scan_json"] = q["scan_csv"]
    q["sink_csv_roundtrip"] = f"{_with(U)} SELECT {ud} FROM user_day"
    q["sink_parquet_roundtrip"] = q["sink_csv_roundtrip"]
    q["sink_json_roundtrip"] = q["sink_csv_roundtrip"]
    q["sink_partitioned"] = (f"{_with(N)} SELECT {nd}, replace(replace(location, ' ', '_'), '/', '_') AS _part "
                             f"FROM nation_day")
    q["parse_dates"] = f"{_with(E)} SELECT location, _ord, date AS date_text, TRY_CAST(date AS DATE) AS date FROM er_raw"
    q["load_stats"] = f"{_with(N)} SELECT count(*) AS rows, count(DISTINCT location) AS entities FROM nation_raw"

    # projections / filters
    q["project"] = f"{_with(N)} SELECT location, date, new_cases, total_cases FROM nation_day"
    q["select_numeric"] = (f"{_with(U)} SELECT location, new_cases, new_deaths, new_tests, total_cases, total_deaths, "
                           f"people_vaccinated, reproduction_rate, stringency_index, population, gdp_per_capita FROM user_day")
    q["drop_intermediate"] = f"{_with(T)} SELECT {td} FROM type_day"
    q["rename_labels"] = (f'{_with(N)} SELECT location, total_cases_per_million AS "Total Cases Per Million", '
                          f'gdp_per_capita AS "GDP Per Capita" FROM nation_latest')
    q["countries_only"] = (f"{_with(N)} SELECT {nr} FROM nation_raw "
                           f"WHERE continent IS NOT NULL AND location IS DISTINCT FROM 'World'")
    q["exclude_aggregates"] = f"{_with(N)} SELECT {nl} FROM nation_latest WHERE {NOT_AGG}"
    q["entity_history"] = f"{_with(N)} SELECT {nr} FROM nation_raw WHERE lower(location) = 'nation_3'"
    q["entities_in"] = f"{_with(N)} SELECT {nl} FROM nation_latest WHERE lower(location) IN ('nation_1', 'nation_7', 'europe')"
    q["entity_semi"] = f"{_with(N)} SELECT {nr} FROM nation_raw WHERE lower(location) IN ('nation_1', 'nation_7', 'europe')"
    q["entity_eq"] = f"{_with(N)} SELECT {nr} FROM nation_raw WHERE location IN ('NATION_2', 'EUROPE')"
    q["date_range"] = f"{_with(T)} SELECT {td} FROM type_day WHERE date >= DATE '2024-01-05' AND date <= DATE '2024-01-20'"
    q["drop_nulls"] = f"{_with(U)} SELECT {ud} FROM user_day WHERE total_deaths IS NOT NULL AND gdp_per_capita IS NOT NULL"
    q["positive_only"] = (f"{_with(N)} SELECT location, new_vaccinations FROM nation_latest WHERE new_vaccinations > 0 "
                          f"OR NOT coalesce((SELECT max(new_vaccinations > 0) FROM nation_latest), false)")
    q["drop_bad_dates"] = f"{_with(E)} SELECT location, date, _ord, new_cases FROM er WHERE date IS NOT NULL"
    q["iqr_trim"] = f"{_with(N, _trimmed('nation_latest', 'total_cases_per_million', 'tr'))} SELECT * FROM tr"
    q["iqr_trim_xy"] = (f"{_with(N, _trimmed('nation_latest', 'gdp_per_capita', 'tx', 'location, continent, ' + OUTCOME))}, "
                        + _trimmed('tx', OUTCOME, 'ty', 'location, continent, gdp_per_capita').strip()
                        + f" SELECT location, continent, gdp_per_capita, {OUTCOME} FROM ty")
    q["prune_null_columns"] = (f"{_with(U)} SELECT location, iso_code, continent, date, _ord, new_cases, new_deaths, "
                               f"new_tests, total_cases, reproduction_rate, stringency_index, population FROM user_day")
    q["head_sample"] = f"{_with(N)} SELECT {nr} FROM nation_raw ORDER BY location, date, _ord LIMIT 10"
    q["sanitize_output"] = (f"{_with(E)} SELECT location, _ord, {_inf_null('positive_rate')} AS positive_rate, "
                            f"{_inf_null('new_cases')} AS new_cases FROM er")

    # joins
    q["group_stat_join"] = (f"{_with(U)} SELECT {ud}, "
                            f"quantile_cont(reproduction_rate, 0.5) OVER (PARTITION BY location) AS reproduction_rate_median, "
                            f"quantile_cont(stringency_index, 0.5) OVER (PARTITION BY location) AS stringency_index_median "
                            f"FROM user_day")
    mets = ["total_cases_per_million", "total_deaths_per_million", "case_fatality_rate", "gdp_per_capita", "extreme_poverty"]
    long = " UNION ALL ".join(f"SELECT location, '{m}' AS metric, {m} AS value FROM nation_latest WHERE {NOT_AGG}"
                              for m in mets)
    dim = ("(VALUES ('total_cases_per_million', 'Cases per million people'), "
           "('total_deaths_per_million', 'Deaths per million people'), "
           "('case_fatality_rate', 'Case fatality rate (%)'), ('gdp_per_capita', 'Mean account balance')) AS dim(metric, label)")
    title = ("array_to_string(list_transform(string_split(replace(l.metric, '_', ' '), ' '), "
             "lambda x: upper(x[1]) || lower(x[2:])), ' ')")
    q["metric_label_join"] = (f"{_with(N)}, lng AS ({long}) SELECT l.metric, l.location, l.value, "
                              f"coalesce(dim.label, {title}) AS label FROM lng l LEFT JOIN {dim} ON l.metric = dim.metric")
    q["aggregate_anti"] = q["exclude_aggregates"]
    q["compare_timeseries"] = f"""{_with(N)},
req(_k, _raw) AS (VALUES ('nation_1', 'NATION_1'), ('nation_7', 'nation_7'), ('atlantis', 'Atlantis')),
pts AS (SELECT lower(location) AS _k, location, date, _ord, {_inf_null('new_cases')} AS value FROM nation_raw
  WHERE lower(location) IN ('nation_1', 'nation_7', 'atlantis') AND date >= DATE '1996-01-01' AND date <= DATE '1996-03-31'),
nm AS (SELECT _k, arg_min(location, (date, _ord)) AS _name FROM pts GROUP BY _k)
SELECT coalesce(nm._name, req._raw) AS entity, pts.date, pts.value
FROM req LEFT JOIN (pts JOIN nm USING (_k)) ON req._k = pts._k"""

    # aggregations
    q["world_sum_by_date"] = (f"{_with(N)} SELECT date, " + ", ".join(
        f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {c}" for c in
        ["total_cases", "new_cases", "total_deaths", "new_deaths", "total_tests", "new_tests", "new_vaccinations"])
        + " FROM nation_raw WHERE continent IS NOT NULL AND location IS DISTINCT FROM 'World' AND date IS NOT NULL GROUP BY date")
    q["last_per_entity"] = (f"{_with(N)} SELECT {nr} FROM (SELECT *, row_number() OVER (PARTITION BY location "
                            f"ORDER BY _ord DESC) AS _rn FROM nation_raw WHERE location IS NOT NULL) WHERE _rn = 1")
    q["weighted_mean"] = f"{_with(N, _world_rollup())} SELECT * FROM w_stat"
    q["world_population"] = f"{_with(N, _world_rollup())} SELECT population FROM w_stat"
    q["world_rollup"] = f"{_with(N, _world_rollup())} SELECT * FROM rolled"
    q["latest_per_entity"] = (f"{_with(N)} SELECT {nr} FROM (SELECT *, row_number() OVER (PARTITION BY location "
                              f"ORDER BY date DESC, _ord ASC) AS _rn FROM nation_raw WHERE location IS NOT NULL AND date IS NOT NULL) WHERE _rn = 1")
    er_cols = ", ".join(ER_COLS)
    q["dedupe_last"] = (f"{_with(E)} SELECT {er_cols} FROM (SELECT *, row_number() OVER (PARTITION BY location, date "
                        f"ORDER BY _ord DESC) AS _rn FROM er) WHERE _rn = 1")
    q["dedupe_rows"] = f"{_with(E)} SELECT location, continent, date, min(_ord) AS _ord FROM er GROUP BY ALL"
    q["entity_list"] = f"{_with(N)} SELECT DISTINCT location FROM nation_raw WHERE location IS NOT NULL"
    titled = ", ".join(f"'{n.title()}'" for n in AGGREGATE_NAMES)
    q["entity_selector"] = (f"{_with(N)} SELECT location FROM nation_raw WHERE location IS NOT NULL AND location NOT IN ({titled}) "
                            f"UNION SELECT 'World' AS location")
    q["bad_date_sample"] = (f"{_with(E)} SELECT DISTINCT date AS date_text FROM er_raw WHERE TRY_CAST(date AS DATE) IS NULL "
                            f"ORDER BY 1 LIMIT 10")
    q["materialize"] = q["sink_parquet_roundtrip"]
    q["save_all_formats"] = (f"{_with(N)} SELECT f.format, count(*) AS rows, count(DISTINCT location) AS entities, min(date) AS min_date, "
                             f"max(date) AS max_date, count(new_cases) AS \"values\" FROM nation_day, "
                             f"(VALUES ('csv'), ('json'), ('parquet')) AS f(format) GROUP BY f.format")
    q["compare_nested"] = (f"SELECT entity, CAST(count(date) OVER (PARTITION BY entity) AS INTEGER) AS points, CASE WHEN date IS NOT NULL THEN "
                           f"CAST(row_number() OVER (PARTITION BY entity ORDER BY date, value) - 1 AS INTEGER) END AS pos, date, value "
                           f"FROM ({q['compare_timeseries']}) AS _c")
    text = lambda c: (
        f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'N/A' WHEN abs({c}) >= 1e9 THEN format('{{:.2f}} B', {c} / 1e9) "
        f"WHEN abs({c}) >= 1e6 THEN format('{{:.2f}} M', {c} / 1e6) WHEN abs({c}) >= 1e3 THEN format('{{:.1f}} K', {c} / 1e3) "
        f"WHEN abs({c}) < 10 AND {c} <> 0 THEN format('{{:.1f}}', {c}) ELSE format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)) END AS {c}_text")
    q["format_number_text"] = (f"{_with(N)} SELECT location, " + ", ".join(
        text(c) for c in ("total_tests", "population", "gdp_per_capita", "extreme_poverty", "new_cases")) + " FROM nation_latest")
    q["entity_count"] = f"{_with(N)} SELECT count(DISTINCT location) AS entities FROM nation_raw"
    q["date_bounds"] = f"{_with(U)} SELECT min(date) AS min_date, max(date) AS max_date FROM user_day"
    q["null_counts"] = f"{_with(U)} {null_counts_sql('user_day', UD_COLS)}"
    q["group_rollup_share"] = f"""{_with(N)},
g AS (SELECT continent, CAST(coalesce(sum(total_cases), 0) AS DOUBLE) AS total_cases FROM nation_latest
  WHERE {NOT_AGG} AND continent IS NOT NULL GROUP BY continent)
SELECT continent, total_cases, total_cases / (SELECT sum(total_cases) FROM g WHERE total_cases > 0) AS share
FROM g WHERE total_cases > 0"""
    q["period_flow_kpis"] = (f"{_with(T)} SELECT location, CASE WHEN count(new_tests) > 0 THEN sum(new_tests) END AS period_total, "
                             f"avg(new_tests) AS daily_mean, max(new_tests) AS peak FROM type_day "
                             f"WHERE date >= DATE '2024-01-08' AND date <= DATE '2024-01-21' GROUP BY location")
    q["period_stock_kpis"] = (f"{_with(U)}, k AS (SELECT location, arg_max(total_deaths, date) FILTER (WHERE total_deaths IS NOT NULL) AS recent_value, "
                              f"arg_min(total_deaths, date) FILTER (WHERE total_deaths IS NOT NULL) AS initial_value FROM user_day "
                              f"WHERE date >= DATE '2024-01-05' AND date <= DATE '2024-01-25' GROUP BY location) "
                              f"SELECT location, recent_value, initial_value, recent_value - initial_value AS increment FROM k")
    q["global_kpis"] = f"""{_with(N, _world_rollup())},
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date DESC, _ord) AS _rn FROM rolled) WHERE _rn = 1)
SELECT CAST(coalesce(sum(total_cases), 0) AS DOUBLE) AS total_cases, CAST(coalesce(sum(new_cases), 0) AS DOUBLE) AS new_cases,
  CAST(coalesce(sum(total_deaths), 0) AS DOUBLE) AS total_deaths, CAST(coalesce(sum(new_deaths), 0) AS DOUBLE) AS new_deaths,
  CASE WHEN count(*) FILTER (WHERE lower(location) = 'world') > 0
       THEN arg_min(population, (location, _ord)) FILTER (WHERE lower(location) = 'world')
       ELSE coalesce(sum(population) FILTER (WHERE {NOT_AGG}), 0) END AS world_population,
  CASE WHEN count(*) FILTER (WHERE lower(location) = 'world') > 0 THEN 'world_row' ELSE 'sum_of_countries' END AS population_source,
  count(DISTINCT location) FILTER (WHERE {NOT_AGG}) AS entities, max(date) AS last_update
FROM lat"""
    q["world_pop_fallback"] = f"""{_with(N)}
SELECT CAST(CASE WHEN count(*) FILTER (WHERE lower(location) = 'world') > 0
       THEN arg_min(population, (location, _ord)) FILTER (WHERE lower(location) = 'world')
       ELSE coalesce(sum(population) FILTER (WHERE {NOT_AGG}), 0) END AS DOUBLE) AS world_population,
  CASE WHEN count(*) FILTER (WHERE lower(location) = 'world') > 0 THEN 'world_row' ELSE 'sum_of_countries' END AS population_source,
  count(DISTINCT location) FILTER (WHERE {NOT_AGG}) AS entities
FROM nation_latest"""
    q["entity_context"] = (f"{_with(N)} SELECT location, population, gdp_per_capita, median_age, life_expectancy FROM "
                           f"(SELECT *, row_number() OVER (PARTITION BY location ORDER BY date DESC, _ord DESC) AS _rn "
                           f"FROM nation_raw WHERE location IS NOT NULL) WHERE _rn = 1")
    m = "total_cases_per_million"
    desc = (f"SELECT avg({m}) AS mean, quantile_cont({m}, 0.5) AS median, stddev_samp({m}) AS std, count(*) AS n, "
            f"quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.75) AS q3 FROM tr")
    q["describe_metric"] = f"{_with(N, _trimmed('nation_latest', m, 'tr'))} {desc}"
    near = (f"SELECT arg_min(location, (abs({m} - s.mean), location)) AS nearest_to_mean, "
            f"arg_min(location, (abs({m} - s.median), location)) AS nearest_to_median, "
            f"first(s.mean) AS mean, first(s.median) AS median "
            f"FROM tr, (SELECT avg({m}) AS mean, quantile_cont({m}, 0.5) AS median FROM tr) s")
    q["nearest_to_center"] = f"{_with(N, _trimmed('nation_latest', m, 'tr'))} {near}"
    q["factor_study"] = f"""{_with(N, _trimmed('nation_latest', m, 'tr'))},
d AS ({desc}),
nr AS (SELECT arg_min(location, (abs({m} - s.mean), location)) AS nearest_to_mean,
  arg_min(location, (abs({m} - s.median), location)) AS nearest_to_median
  FROM tr, (SELECT avg({m}) AS mean, quantile_cont({m}, 0.5) AS median FROM tr) s)
SELECT * FROM d, nr"""
    g = "gdp_per_capita"
    q["histogram"] = f"""{_with(N, _trimmed('nation_latest', g, 'tr'))},
mm AS (SELECT min({g}) AS _min, max({g}) AS _max FROM tr),
b AS (SELECT CAST(CASE WHEN _max - _min > 0 THEN least(floor(({g} - _min) / (_max - _min) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS bin,
  _min, _max FROM tr, mm)
SELECT bin, _min + (bin - 1) * ((_max - _min) / 50) AS lower, _min + bin * ((_max - _min) / 50) AS upper, count(*) AS count
FROM b GROUP BY bin, _min, _max"""
    q["box_stats"] = f"""{_with(N, _trimmed('nation_latest', m, 'tr'))},
qs AS (SELECT continent, quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.5) AS median, quantile_cont({m}, 0.75) AS q3
  FROM tr WHERE continent IS NOT NULL GROUP BY continent),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM qs)
SELECT f.continent, count(*) AS n, first(f.q1) AS q1, first(f.median) AS median, first(f.q3) AS q3,
  first(f.lower_fence) AS lower_fence, first(f.upper_fence) AS upper_fence,
  min({m}) FILTER (WHERE {m} >= f.lower_fence AND {m} <= f.upper_fence) AS whisker_low,
  max({m}) FILTER (WHERE {m} >= f.lower_fence AND {m} <= f.upper_fence) AS whisker_high,
  count(*) FILTER (WHERE NOT ({m} >= f.lower_fence AND {m} <= f.upper_fence)) AS outliers
FROM tr JOIN f USING (continent) GROUP BY f.continent"""
    allf = [OUTCOME] + FACTORS
    sp_long = " UNION ALL ".join(f"SELECT location, '{c}' AS factor, {c} AS value FROM base" for c in allf)
    spear = f"""{_with(N)},
base AS (SELECT * FROM nation_latest WHERE {NOT_AGG} AND {' AND '.join(f'{c} IS NOT NULL' for c in allf)}),
lng AS ({sp_long}),
rk AS (SELECT location, factor, {_ranked_avg('lng', 'factor', 'value')} AS rank FROM lng),
y AS (SELECT location, rank AS ry FROM rk WHERE factor = '{OUTCOME}'),
sp AS (SELECT factor, corr(rank, ry) AS rho, count(*) AS n FROM rk JOIN y USING (location)
  WHERE factor <> '{OUTCOME}' GROUP BY factor HAVING count(*) >= 10)"""
    q["spearman"] = f"{spear} SELECT * FROM sp"
    q["topk_correlation"] = (f"{spear}, top AS (SELECT * FROM sp ORDER BY abs(rho) DESC NULLS LAST, factor LIMIT 15) "
                             f"SELECT factor, rho, n, CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS sign FROM top")
    q["ols_by_group"] = (f"{_with(N, _trimmed('nation_latest', g, 'tx', 'location, continent, ' + OUTCOME))}, "
                         + _trimmed('tx', OUTCOME, 'ty', 'location, continent, gdp_per_capita').strip()
                         + f" SELECT continent, regr_slope({OUTCOME}, {g}) AS slope, regr_intercept({OUTCOME}, {g}) AS intercept, "
                         f"regr_r2({OUTCOME}, {g}) AS r2, CAST(regr_count({OUTCOME}, {g}) AS BIGINT) AS n FROM ty "
                         f"WHERE continent IS NOT NULL GROUP BY continent")
    types = ",".join(f"{c}:{t}" for c, t in zip(UD_COLS, ["string", "string", "string", "date", "bigint"] + ["double"] * 11))
    q["dataset_metadata"] = (f"{_with(U)} SELECT count(*) AS total_rows, min(date) AS date_start, max(date) AS date_end, "
                             f"count(DISTINCT location) AS locations, CAST({len(UD_COLS)} AS BIGINT) AS total_columns, "
                             f"'{','.join(UD_COLS)}' AS columns, '{types}' AS data_types FROM user_day")
    q["column_profile"] = f"{_with(U)} " + _profile_sql()
    q["minmax_score"] = _score_sql(None)
    q["compare_scores"] = _score_sql(SCORE_ENTITIES)
    ent_in = _lit_list(SCORE_ENTITIES)
    q["unpivot_scores"] = (f"{_with(N)} " + " UNION ALL ".join(
        f"SELECT location, '{mm}' AS metric, {mm} AS value FROM nation_latest WHERE {NOT_AGG} AND location IN ({ent_in})"
        for mm in SCORE_METRICS))
    piv_ents = [e for e in SCORE_ENTITIES if e != "EUROPE"]
    q["pivot_scores"] = (_score_sql(SCORE_ENTITIES, as_cte=True) + " SELECT metric, " + ", ".join(
        f"first(score) FILTER (WHERE location = '{e}') AS {_q(e)}" for e in piv_ents) + " FROM sc GROUP BY metric")
    q["cleaning_report"] = f"""{_with(E, ER_CLEAN)}
SELECT (SELECT count(*) FROM er) - (SELECT count(*) FROM cl_dd) AS duplicates_removed,
  CAST(1 AS BIGINT) AS columns_dropped, 'icu_patients' AS dropped_column_names,
  (SELECT CAST(sum(_f) AS BIGINT) FROM (SELECT {iqr_flags_sql(ER_CAP)} AS _f FROM cl_num)) AS outliers_handled"""
    nul = lambda src, cols: " + ".join(f"count(*) - count({c})" for c in cols)
    q["imputation_report"] = f"""{_with(U, _ud_impute())},
c AS (SELECT
  (SELECT {nul('', UD_FFILL)} FROM im1) - (SELECT {nul('', UD_FFILL)} FROM im2) AS forward_filled,
  (SELECT {nul('', UD_INTERP)} FROM im3) - (SELECT {nul('', UD_INTERP)} FROM im4) AS interpolated,
  (SELECT {nul('', UD_STAT)} FROM im4) - (SELECT {nul('', UD_STAT)} FROM im5) AS filled_with_stats,
  (SELECT {nul('', UD_NEW)} FROM im2) AS filled_new_with_zero)
SELECT CAST(forward_filled AS BIGINT) AS forward_filled, CAST(interpolated AS BIGINT) AS interpolated,
  CAST(filled_with_stats AS BIGINT) AS filled_with_stats, CAST(filled_new_with_zero AS BIGINT) AS filled_new_with_zero FROM c"""

    # windows
    q["static_fill"] = f"{_with(U)} SELECT " + ", ".join(
        c if c not in UD_STATIC else
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}), first_value({c} IGNORE NULLS) OVER ({_wt(WHOLE)})) AS {c}"
        for c in UD_COLS) + " FROM user_day"
    q["forward_fill"] = f"{_with(U)} SELECT " + ", ".join(
        c if c not in UD_FFILL else f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS {c}" for c in UD_COLS) + " FROM user_day"
    q["zero_fill"] = f"{_with(U)} SELECT " + ", ".join(
        c if c not in UD_NEW else f"coalesce({c}, 0.0) AS {c}" for c in UD_COLS) + " FROM user_day"
    q["interpolate_bounded"] = f"{_with(U, interp_ctes('user_day', 'ip', UD_COLS, UD_INTERP))} SELECT {ud} FROM ip"
    for key, meth in (("fill_median", "quantile_cont({c}, 0.5)"), ("fill_mean", "avg({c})")):
        q[key] = f"{_with(U)} SELECT " + ", ".join(
            c if c not in UD_STAT else f"coalesce({c}, {meth.format(c=c)} OVER (PARTITION BY location)) AS {c}"
            for c in UD_COLS) + " FROM user_day"
    td_cap = ["new_cases", "new_deaths", "new_tests", "total_cases", "total_deaths", "total_tests",
              "reproduction_rate", "stringency_index"]
    q["cap_iqr"] = f"{_with(T)} SELECT {cap_iqr_sql(TD_COLS, td_cap)} FROM type_day"
    zs = []
    for c in UD_COLS:
        if c not in UD_STAT:
            zs.append(c)
            continue
        mean = f"avg({c}) OVER (PARTITION BY location)"
        sd = f"nullif(stddev_samp({c}) OVER (PARTITION BY location), 0)"
        z = f"coalesce(({c} - {mean}) / {sd}, 0.0)"
        zs.append(f"CASE WHEN {z} < -3.0 THEN {mean} - 3.0 * {sd} WHEN {z} > 3.0 THEN {mean} + 3.0 * {sd} ELSE {c} END AS {c}")
    q["cap_zscore"] = f"{_with(U)} SELECT {', '.join(zs)} FROM user_day"
    ma = ", ".join(f"avg({c}) OVER ({_wt(f'ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW')}) AS {c}_ma{w}"
                   for c in ["new_cases", "new_deaths", "new_tests"] for w in (7, 14))
    q["moving_average"] = f"{_with(T)} SELECT {td}, {ma} FROM type_day"
    ca = ", ".join(f"avg({c}) OVER ({_wt('ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING')}) AS {c}_avg_7"
                   for c in ["new_cases", "reproduction_rate"])
    q["centered_average"] = f"{_with(U)} SELECT {ud}, {ca} FROM user_day"
    gr_ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS _ff_{c}" for c in UD_FFILL)
    gr = ", ".join(
        f"CASE WHEN g_{c} IS NOT NULL THEN least(greatest(g_{c}, -1000.0), 1000.0) END AS {c}_growth_rate" for c in UD_FFILL)
    gr_raw = ", ".join(f"(_ff_{c} / nullif(lag(_ff_{c}, 1) OVER ({_wt()}), 0) - 1.0) * 100.0 AS g_{c}" for c in UD_FFILL)
    q["growth_rate"] = (f"{_with(U)}, f AS (SELECT *, {gr_ff} FROM user_day), g AS (SELECT *, {gr_raw} FROM f) "
                        f"SELECT {ud}, {gr} FROM g")
    lags = ", ".join(f"lag({c}, {k}) OVER ({_wt()}) AS {c}_lag{k}" for c in ["new_cases", "new_deaths", "new_tests"]
                     for k in (1, 7, 14))
    q["lag_features"] = f"{_with(U)} SELECT {ud}, {lags} FROM user_day"
    rt_cols = [c for c in UD_COLS if c not in ("total_cases", "total_deaths")]
    rt = ", ".join(f"coalesce(CASE WHEN {s} IS NOT NULL THEN sum({s}) OVER ({_wt(ROWS)}) END, 0.0) AS {d}"
                   for s, d in (("new_cases", "total_cases"), ("new_deaths", "total_deaths"), ("new_tests", "total_tests")))
    q["running_total"] = f"{_with(U)} SELECT {', '.join(rt_cols)}, {rt} FROM user_day"
    q["first_difference"] = (f"{_with(U)} SELECT {ud}, " + ", ".join(
        f"{c} - lag({c}, 1) OVER ({_wt()}) AS {c}_diff" for c in ["new_cases", "new_deaths"]) + " FROM user_day")
    q["days_since_first"] = (f"{_with(U)} SELECT {ud}, CAST(date_diff('day', min(date) OVER (PARTITION BY location), date) "
                             f"AS INTEGER) AS days_since_first_case FROM user_day")
    q["average_rank"] = (f"{_with(N)}, b AS (SELECT location, new_cases FROM nation_latest WHERE {NOT_AGG}) "
                         f"SELECT location, new_cases, rank() OVER (ORDER BY new_cases) "
                         f"+ (count(*) OVER (PARTITION BY new_cases) - 1) / 2.0 AS rank FROM b")
    cal = ("CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, "
           "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(date) AS INTEGER) AS week_of_year, "
           "CAST(quarter(date) AS INTEGER) AS quarter, CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend")
    q["calendar_features"] = f"{_with(T)} SELECT {td}, {cal} FROM type_day"

    # sorts
    q["sorted_panel"] = f"{_with(T)} SELECT {td} FROM type_day ORDER BY location, date, _ord"
    q["compare_bar"] = (f"{_with(N)} SELECT location, total_cases_per_million FROM nation_latest WHERE {NOT_AGG} "
                        f"AND location IN ({ent_in}) ORDER BY total_cases_per_million DESC NULLS LAST, location")
    q["recent_first"] = f"{_with(T)} SELECT {td} FROM type_day WHERE lower(location) = 'click' ORDER BY date DESC"

    # set / reshape
    wsum = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {c}" for c in
                     ["total_cases", "new_cases", "total_deaths", "new_deaths", "total_tests", "new_tests", "new_vaccinations"])
    q["union_by_name"] = (f"{_with(N)}, w AS (SELECT date, {wsum} FROM nation_raw WHERE continent IS NOT NULL AND "
                          f"location IS DISTINCT FROM 'World' AND date IS NOT NULL GROUP BY date) "
                          f"SELECT {nd} FROM nation_day UNION ALL BY NAME SELECT 'World' AS location, * FROM w")

    # scalars
    q["safe_division"] = (f"{_with(U)} SELECT location, date, new_deaths / nullif(new_cases, 0) * 100.0 AS purchase_share, "
                          f"total_deaths / nullif(new_deaths, 0) * 1.0 AS stock_per_flow FROM user_day")
    q["inf_to_null"] = f"{_with(E)} SELECT location, _ord, {_inf_null('positive_rate')} AS positive_rate FROM er"
    q["clamp_negative"] = f"{_with(E)} SELECT location, _ord, {_clamp('new_deaths')} AS new_deaths FROM er"
    q["rate_features"] = (f"{_with(U)} SELECT {ud}, total_deaths / nullif(total_cases, 0) * 100.0 AS case_fatality_rate, "
                          f"new_cases / nullif(new_tests, 0) * 100.0 AS positive_rate FROM user_day")
    pc = [("total_cases", "total_cases_per_million", "1000000.0"), ("total_deaths", "total_deaths_per_million", "1000000.0"),
          ("new_cases", "new_cases_per_million", "1000000.0"), ("new_deaths", "new_deaths_per_million", "1000000.0"),
          ("new_tests", "new_tests_per_thousand", "1000.0")]
    pcs = ", ".join(f"{b} / nullif(population, 0) * {k} AS {p}" for b, p, k in pc)
    q["per_capita"] = f"{_with(U)} SELECT {ud}, {pcs} FROM user_day"
    q["date_text"] = f"{_with(T)} SELECT location, date, strftime(date, '%Y-%m-%d') AS date_text FROM type_day"
    q["log_metric"] = (f"{_with(N)} SELECT location, CASE WHEN new_vaccinations > 0 THEN log10(new_vaccinations) END "
                       f"AS log_new_vaccinations FROM nation_latest")

    # pipelines
    q["clean_pipeline"] = f"{_with(E, ER_CLEAN)} SELECT * FROM cleaned"
    q["impute_pipeline"] = f"{_with(U, _ud_impute())} SELECT {ud} FROM im5"
    q["feature_pipeline"] = _feature_sql()
    q["map_feed"] = f"{_with(N)} SELECT iso_code, location, total_cases FROM nation_latest WHERE {NOT_AGG}"
    q["period_analysis"] = (f"{_with(T)}, p AS (SELECT location, date, _ord, new_cases FROM type_day "
                            f"WHERE date >= DATE '2024-01-03' AND date <= DATE '2024-01-27') "
                            f"SELECT location, date, new_cases, avg(new_cases) OVER ({_wt('ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING')}) "
                            f"AS new_cases_avg_7 FROM p")
    q["pipeline_audit"] = _audit_sql()
    q["etl_pipeline"] = _etl_sql()
    return q | _cross_section_sql() | _period_sql(q) | _store_sql(q)


CUSTOMER = """
cu_o AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS _n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS _f,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS _v, max(CAST(o_orderdate AS DATE)) AS _d FROM orders GROUP BY 1),
customer_latest AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS location, c_mktsegment AS iso_code, n_name AS continent, _d AS date,
    CAST(c_custkey AS BIGINT) AS _ord, coalesce(_n, 0.0) AS total_cases, _f AS total_deaths, CAST(_v AS DOUBLE) AS total_tests,
    CAST(_v AS DOUBLE) / _n AS median_age, c_acctbal AS gdp_per_capita,
    CAST(CAST(c_acctbal AS DECIMAL(18,2)) - _v AS DOUBLE) AS extreme_poverty, coalesce(_n, 0.0) AS population_density,
    _f / _n * 100.0 AS life_expectancy
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cu_o ON o_custkey = c_custkey)"""
CL_COLS = {"location": "string", "iso_code": "string", "continent": "string", "date": "date", "total_cases": "numeric",
           "total_deaths": "numeric", "total_tests": "numeric", "median_age": "numeric", "gdp_per_capita": "numeric",
           "extreme_poverty": "numeric", "population_density": "numeric", "life_expectancy": "numeric"}


def _describe(m: str, src: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return (f"SELECT {key}avg({m}) AS mean, quantile_cont({m}, 0.5) AS median, stddev_samp({m}) AS std, count(*) AS n, "
            f"quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.75) AS q3 FROM {src} WHERE {m} IS NOT NULL" + (f" GROUP BY {by}" if by else ""))


def _boxes(m: str, src: str, factor: float = 1.5) -> str:
    """CTEs ``f`` (fences of each group) and ``j`` (rows beside their fences)."""
    return f"""
qs AS (SELECT continent, quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.5) AS median, quantile_cont({m}, 0.75) AS q3
  FROM {src} WHERE continent IS NOT NULL AND {m} IS NOT NULL GROUP BY continent),
f AS (SELECT *, q1 - {factor} * (q3 - q1) AS lower_fence, q3 + {factor} * (q3 - q1) AS upper_fence FROM qs),
j AS (SELECT b.location, b.{m}, f.*, b.{m} >= f.lower_fence AND b.{m} <= f.upper_fence AS inside
  FROM {src} b JOIN f ON b.continent = f.continent WHERE b.{m} IS NOT NULL)"""


def _study_sql(m: str, log_scale: bool, trim: bool) -> str:
    base = _trimmed("customer_latest", m, "tr") if trim else (
        f"tr AS (SELECT location, continent, {m} FROM customer_latest WHERE {NOT_AGG} AND {m} IS NOT NULL)")
    drawn = f"SELECT * FROM tr WHERE {m} > 0 OR NOT (SELECT max({m} > 0) FROM tr)" if log_scale else "SELECT * FROM tr"
    no = lambda t: f"CAST(NULL AS {t})"
    dbl = no("DOUBLE")
    pick = lambda k: f"(SELECT arg_min((location, {m}), (abs({m} - s.{k}), location)) FROM dr, s)"
    near = [f"SELECT 'representative', 'nearest_to_{k}', w[1], w[2], {dbl}, {dbl}, {no('BIGINT')} FROM (SELECT {pick(k)} AS w)" for k in ("mean", "median")]
    summary = [f"SELECT 'summary', '{k}', {no('VARCHAR')}, CAST(s.{k} AS DOUBLE), {dbl}, {dbl}, {no('BIGINT')} FROM s"
               for k in ("mean", "median", "std", "n", "q1", "q3")]
    box = [f"SELECT 'box', '{k}', continent, {e}, {dbl}, {dbl}, count(*) FROM j GROUP BY continent" for k, e in (
        *[(k, f"first({k})") for k in ("q1", "median", "q3", "lower_fence", "upper_fence")],
        ("whisker_low", f"min({m}) FILTER (WHERE inside)"), ("whisker_high", f"max({m}) FILTER (WHERE inside)"))]
    rest = [f"""SELECT 'histogram', CAST(bin AS VARCHAR), {no('VARCHAR')}, {dbl}, lo + (bin - 1) * ((hi - lo) / 50), lo + bin * ((hi - lo) / 50), count(*)
FROM (SELECT CAST(CASE WHEN hi > lo THEN least(floor(({m} - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS bin, lo, hi FROM dr, mm) GROUP BY bin, lo, hi""",
            f"SELECT 'outlier', continent, location, {m}, lower_fence, upper_fence, {no('BIGINT')} FROM j WHERE NOT inside"]
    first = ("SELECT 'summary' AS section, '-' AS item, '' AS label, 0.0 AS value, 0.0 AS lower, 0.0 AS upper, CAST(0 AS BIGINT) AS count WHERE false")
    return (f"{_with(CUSTOMER, base)}, s AS ({_describe(m, 'tr')}), dr AS ({drawn}), mm AS (SELECT min({m}) AS lo, max({m}) AS hi FROM dr),"
            + _boxes(m, "dr") + " " + " UNION ALL ".join([first, *summary, *near, *box, *rest]))


def _cross_section_sql() -> dict[str, str]:
    """Statistics over one row a customer."""
    m, C, q = "extreme_poverty", CUSTOMER, {}
    ranked = lambda cols, by, v: (
        f"{_with(C)} SELECT {cols}, CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY {by}{v} IS NULL ORDER BY {v}) "
        f"+ (count(*) OVER (PARTITION BY {by}{v}) - 1) / 2.0 END AS rank FROM customer_latest")
    q["customer_rank"] = ranked(f"location, {m}", "", m)
    q["customer_rank_by_nation"] = ranked("location, continent, total_cases", "continent, ", "total_cases")
    q["customer_trim"] = f"{_with(C, _trimmed('customer_latest', m, 'tr'))} SELECT * FROM tr"
    q["customer_trim_by_nation"] = f"""{_with(C)}, b AS (SELECT location, continent, {m},
  count(*) OVER w AS _n, quantile_cont({m}, 0.25) OVER w AS _q1, quantile_cont({m}, 0.75) OVER w AS _q3
  FROM customer_latest WHERE {m} IS NOT NULL WINDOW w AS (PARTITION BY continent)),
c AS (SELECT *, CASE WHEN _q3 - _q1 > 0 THEN _q3 - _q1 ELSE 1.0 END AS _i FROM b)
SELECT location, continent, {m} FROM c WHERE _n <= 1 OR ({m} >= _q1 - 0.5 * _i AND {m} <= _q3 + 0.5 * _i)"""
    xy = [_trimmed("customer_latest", m, "tx", "location, continent, median_age"), _trimmed("tx", "median_age", "ty", f"location, continent, {m}")]
    q["customer_trim_xy"] = f"{_with(C, *xy)} SELECT location, continent, {m}, median_age FROM ty"
    q["customer_describe"] = f"{_with(C)} {_describe(m, 'customer_latest')}"
    q["customer_describe_by_nation"] = f"{_with(C)} {_describe(m, 'customer_latest', 'continent')}"
    q["customer_nearest"] = f"""{_with(C)}, s AS ({_describe(m, 'customer_latest')})
SELECT arg_min(location, (abs({m} - s.mean), location)) AS nearest_to_mean, arg_min(location, (abs({m} - s.median), location)) AS nearest_to_median,
  first(s.mean) AS mean, first(s.median) AS median FROM customer_latest, s WHERE {m} IS NOT NULL"""
    q["customer_histogram"] = f"""{_with(C, _trimmed('customer_latest', m, 'tr'))}, mm AS (SELECT min({m}) AS lo, max({m}) AS hi FROM tr),
b AS (SELECT CAST(least(floor(({m} - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS bin, lo, hi FROM tr, mm)
SELECT bin, lo + (bin - 1) * ((hi - lo) / 50) AS lower, lo + bin * ((hi - lo) / 50) AS upper, count(*) AS count FROM b GROUP BY bin, lo, hi"""
    q["customer_box"] = f"""{_with(C)}, {_boxes(m, 'customer_latest')}
SELECT continent, count(*) AS n, first(q1) AS q1, first(median) AS median, first(q3) AS q3, first(lower_fence) AS lower_fence,
  first(upper_fence) AS upper_fence, min({m}) FILTER (WHERE inside) AS whisker_low, max({m}) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY continent"""
    t = "total_tests"
    q["box_outliers"] = f"""{_with(C)}, {_boxes(t, 'customer_latest', 1.0)}
SELECT continent, location, {t}, CASE WHEN {t} > upper_fence THEN 'high' ELSE 'low' END AS side,
  CASE WHEN {t} > upper_fence THEN upper_fence ELSE lower_fence END AS fence FROM j WHERE NOT inside"""
    factors = ["gdp_per_capita", "population_density", "life_expectancy", "median_age"]
    lng = " UNION ALL ".join(f"SELECT location, '{c}' AS factor, {c} AS value FROM base" for c in [m, *factors])
    q["customer_spearman"] = f"""{_with(C)}, base AS (SELECT * FROM customer_latest WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [m, *factors])}),
lng AS ({lng}), rk AS (SELECT location, factor, {_ranked_avg('lng', 'factor', 'value')} AS rank FROM lng),
y AS (SELECT location, rank AS ry FROM rk WHERE factor = '{m}')
SELECT factor, corr(rank, ry) AS rho, count(*) AS n FROM rk JOIN y USING (location) WHERE factor <> '{m}' GROUP BY factor HAVING count(*) >= 10"""
    g = "gdp_per_capita"
    xy = [_trimmed("customer_latest", m, "tx", f"location, continent, {g}"), _trimmed("tx", g, "ty", f"location, continent, {m}")]
    q["customer_ols"] = (f"{_with(C, *xy)} SELECT continent, regr_slope({g}, {m}) AS slope, regr_intercept({g}, {m}) AS intercept, "
                         f"regr_r2({g}, {m}) AS r2, CAST(regr_count({g}, {m}) AS BIGINT) AS n FROM ty GROUP BY continent")
    q["customer_profile"] = f"{_with(C)} " + _profile_sql("customer_latest", CL_COLS)
    q["factor_study_full"] = _study_sql(g, False, True)
    q["factor_study_log"] = _study_sql(g, True, False)
    q["entity_count_approx"] = f"{_with(C)} SELECT count(DISTINCT location) AS entities, true AS near FROM customer_latest"
    return q


def _period_sql(q: dict[str, str]) -> dict[str, str]:
    """The period view and the reports of the audit."""
    out, U = {}, USER_DAY
    rng = "date >= DATE '2024-01-05' AND date <= DATE '2024-01-25'"
    metrics = {"new_cases": "Events a day", "new_deaths": "New Deaths", "total_cases": "Events so far", "total_deaths": "Total Deaths",
               "stringency_index": "Highest value"}
    parts = []
    for c, label in metrics.items():
        flow = c.startswith("new_")
        known = f"FILTER (WHERE {rng} AND {c} IS NOT NULL)"
        one = ([f"sum({c}) FILTER (WHERE {rng})", f"avg({c}) FILTER (WHERE {rng})", f"max({c}) FILTER (WHERE {rng})", "NULL", "NULL"] if flow else
               ["NULL", "NULL", "NULL", f"arg_max({c}, date) {known}", f"arg_min({c}, date) {known}"])
        names = ["period_total", "daily_mean", "peak", "recent_value", "initial_value"]
        parts.append(f"SELECT location, '{c}' AS metric, '{label}' AS label, '{'flow' if flow else 'stock'}' AS kind, "
                     + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(one, names))
                     + f" FROM user_day GROUP BY location HAVING count(*) FILTER (WHERE {rng}) > 0")
    out["period_view"] = f"""{_with(U)}, ctx AS (SELECT location, population, gdp_per_capita FROM (SELECT *,
  row_number() OVER (PARTITION BY location ORDER BY date DESC, _ord DESC) AS _rn FROM user_day) WHERE _rn = 1),
m AS ({' UNION ALL '.join(parts)})
SELECT m.*, recent_value - initial_value AS increment, population, gdp_per_capita FROM m JOIN ctx USING (location)"""
    avg = ", ".join(f"avg({c}) OVER ({_wt('ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING')}) AS {c}_avg_7" for c in metrics if c.startswith("new_"))
    out["period_series"] = f"{_with(U)}, r AS (SELECT * FROM user_day WHERE {rng}) SELECT location, date, {', '.join(metrics)}, {avg} FROM r"
    cols = "location, date, new_cases, total_cases"
    one = lambda name, src, icu: (
        f"SELECT '{name}' AS stage, CAST(row_number() OVER (ORDER BY location, date, _ord) AS INTEGER) AS place, {cols}, {icu} AS icu_patients FROM {src}")
    out["audit_samples"] = (f"{_with(U, UD_CLEAN)}, s AS ({one('raw', 'user_day', 'icu_patients')} UNION ALL "
                            f"{one('cleaned', 'ucleaned', 'CAST(NULL AS DOUBLE)')}) SELECT * FROM s WHERE place <= 5")
    reports = [("clean", "cleaning_report", ["duplicates_removed", "columns_dropped", "outliers_handled"]),
               ("impute", "imputation_report", ["forward_filled", "interpolated", "filled_with_stats", "filled_new_with_zero"])]
    out["audit_reports"] = " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{c}' AS measure, {c} AS value FROM ({q[key]}) AS _r" for stage, key, names in reports for c in names)
    return out


def _store_sql(q: dict[str, str]) -> dict[str, str]:
    """Stored forms: keyed and bucketed panels, numbered files, documents, segmented windows."""
    nr, out = ", ".join(ND_COLS), {}
    out["records_json_parsed"] = q["latest_per_entity"]
    out["latest_for"] = f"SELECT * FROM ({q['latest_per_entity']}) AS _l WHERE lower(location) IN ('nation_1', 'nation_7', 'europe')"
    out["entity_moving_average"] = f"SELECT * FROM ({q['moving_average']}) AS _m WHERE lower(location) = 'click'"
    out["materialize_bucketed"] = (
        f"{_with(TYPE_DAY)} SELECT {', '.join(TD_COLS)}, CAST(date_diff('day', min(date) OVER (PARTITION BY location), date) AS INTEGER) AS days_since_first_case, "
        + ", ".join(f"avg(new_cases) OVER ({_wt(f'ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW')}) AS new_cases_ma{w}" for w in (7, 14)) + " FROM type_day")
    out["scan_csv_files"] = f"""{_with(EVENT_REPORTS)}, n AS (SELECT * REPLACE (row_number() OVER (ORDER BY _ord) - 1 AS _ord) FROM er)
SELECT location, date, _ord, new_cases, hosp_patients FROM (SELECT *, row_number() OVER (PARTITION BY location, date ORDER BY _ord DESC) AS _rn FROM n) WHERE _rn = 1"""
    types = dict(zip(UD_COLS, ["string", "string", "string", "date", "bigint"] + ["double"] * 11))
    listed = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(types.items()))
    out["metadata_document"] = f"""{_with(USER_DAY)}
SELECT count(*) AS total_rows, CAST({len(UD_COLS)} AS BIGINT) AS total_columns, min(date) AS date_start, max(date) AS date_end,
  count(DISTINCT location) AS locations, 'events' AS origin, CAST(2 AS INTEGER) AS custom_entries,
  CAST(place AS INTEGER) AS place, "column", type FROM user_day, (VALUES {listed}) AS c(place, "column", type) GROUP BY place, "column", type"""
    means = ["median_age", "gdp_per_capita"]
    out["weighted_mean_nonnull"] = f"""{_with(USER_DAY)}, u AS (SELECT *, CASE WHEN new_deaths > 0 THEN reproduction_rate END AS median_age FROM user_day),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY _ord DESC) AS _rn FROM u
  WHERE continent IS NOT NULL AND location <> 'World') WHERE _rn = 1)
SELECT CAST(coalesce(sum(population), 0) AS DOUBLE) AS population, {', '.join(
        f"CASE WHEN sum(population) FILTER (WHERE {c} IS NOT NULL) > 0 THEN coalesce(sum({c} * population), 0.0) / sum(population) FILTER (WHERE {c} IS NOT NULL) END AS {c}"
        for c in means)} FROM l"""
    for key, plain in (("static_fill", "static_fill"), ("forward_fill", "forward_fill"), ("running_total", "running_total"),
                       ("moving_average", "moving_average"), ("interpolate", "interpolate_bounded"), ("fill_median", "fill_median"), ("cap_iqr", "cap_iqr")):
        out[f"segmented_{key}"] = q[plain]
    return out


def _score_sql(entities, as_cte: bool = False) -> str:
    where = f"{NOT_AGG}" + (f" AND location IN ({_lit_list(entities)})" if entities else "")
    notnull = " AND ".join(f"{m} IS NOT NULL" for m in SCORE_METRICS)
    long = " UNION ALL ".join(f"SELECT location, '{m}' AS metric, {m} AS value FROM b" for m in SCORE_METRICS)
    hib = _lit_list(HIGHER_IS_BETTER)
    body = f"""{_with(NATION)},
b AS (SELECT * FROM nation_latest WHERE {where} AND {notnull}),
l AS ({long}),
mm AS (SELECT metric, min(value) AS _min, max(value) AS _max FROM l GROUP BY metric),
sc AS (SELECT l.location, l.metric, l.value,
  CASE WHEN _max - _min = 0 THEN 0.5
       WHEN l.metric IN ({hib}) THEN (l.value - _min) / (_max - _min)
       ELSE 1.0 - (l.value - _min) / (_max - _min) END AS score
  FROM l JOIN mm USING (metric))"""
    return body if as_cte else body + " SELECT * FROM sc"


def _profile_sql(src: str = "user_day", columns=None) -> str:
    parts = []
    for c in columns or UD_COLS:
        if c == "_ord":
            continue
        miss = f"count(*) - count({c}) AS missing_count, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_percentage"
        if c in ("location", "iso_code", "continent"):
            parts.append(
                f"SELECT '{c}' AS \"column\", 'string' AS kind, count({c}) AS count, "
                f"(SELECT count(DISTINCT {c}) FROM {src}) AS \"unique\", "
                f"(SELECT arg_min(v, (-n, v)) FROM (SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)) AS top, "
                f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})) AS freq, "
                f"CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                f"CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, "
                f"CAST(NULL AS DOUBLE) AS max, {miss} FROM {src}")
        else:
            x = f"CAST({c} - {EPOCH} AS DOUBLE)" if c == "date" else f"CAST({c} AS DOUBLE)"
            kind = "date" if c == "date" else "numeric"
            std = "CAST(NULL AS DOUBLE)" if c == "date" else f"stddev_samp({x})"
            parts.append(
                f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
                f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, avg({x}) AS mean, {std} AS std, "
                f"min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, "
                f"quantile_cont({x}, 0.75) AS q75, max({x}) AS max, {miss} FROM {src}")
    return " UNION ALL ".join(parts)


def _feature_sql() -> str:
    ud = ", ".join(UD_COLS)
    pc = [("total_cases", "total_cases_per_million", "1000000.0"), ("total_deaths", "total_deaths_per_million", "1000000.0"),
          ("new_cases", "new_cases_per_million", "1000000.0"), ("new_deaths", "new_deaths_per_million", "1000000.0"),
          ("new_tests", "new_tests_per_thousand", "1000.0")]
    pcs = ", ".join(f"{b} / nullif(population, 0) * {k} AS {p}" for b, p, k in pc)
    gr_ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS _ff_{c}" for c in UD_FFILL)
    gr_raw = ", ".join(f"(_ff_{c} / nullif(lag(_ff_{c}, 1) OVER ({_wt()}), 0) - 1.0) * 100.0 AS g_{c}" for c in UD_FFILL)
    gr = ", ".join(f"CASE WHEN g_{c} IS NOT NULL THEN least(greatest(g_{c}, -1000.0), 1000.0) END AS {c}_growth_rate"
                   for c in UD_FFILL)
    rt = f"coalesce(CASE WHEN new_tests IS NOT NULL THEN sum(new_tests) OVER ({_wt(ROWS)}) END, 0.0) AS total_tests"
    return f"""{_with(USER_DAY)},
f AS (SELECT *, {gr_ff} FROM user_day), g AS (SELECT *, {gr_raw} FROM f)
SELECT {ud}, {pcs}, total_deaths / nullif(total_cases, 0) * 100.0 AS case_fatality_rate,
  new_cases / nullif(new_tests, 0) * 100.0 AS positive_rate, {gr}, {rt} FROM g"""


def _audit_sql() -> str:
    cl_cols = UD_CLEAN_COLS
    im = impute_ctes("ucleaned", cl_cols, ["population"], ["total_cases"], ["new_cases", "new_deaths", "new_tests"],
                     ["total_cases", "reproduction_rate", "stringency_index"],
                     ["new_cases", "new_deaths", "new_tests", "total_cases", "reproduction_rate", "stringency_index"], "ai")
    parts = []
    for stage, src, cols in (("raw", "user_day", UD_COLS), ("cleaned", "ucleaned", cl_cols), ("imputed", "ai5", cl_cols)):
        for c in cols:
            parts.append(f"SELECT '{stage}' AS stage, '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
                         f"count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns FROM {src}")
    return f"{_with(USER_DAY, UD_CLEAN, im)} " + " UNION ALL ".join(parts)


ETL_STATIC = ["population", "population_density", "gdp_per_capita", "extreme_poverty", "life_expectancy", "median_age"]
ETL_NEW = ["new_cases", "new_deaths", "new_tests", "new_vaccinations"]
ETL_TOTAL = ["total_cases", "total_deaths", "total_tests"]
ETL_CLAMP = ETL_NEW + ETL_TOTAL + ["population", "population_density"]


def _etl_sql() -> str:
    """X4 on nation_raw: rollup -> clean -> impute -> features.

    The null-ratio step drops no column of this panel at sf0.01 (largest null
    share: population_density, 15 %), so the column list is fixed here.
    """
    cols = ND_COLS
    num = [c for c in cols if c not in ("location", "iso_code", "continent", "date", "_ord")]
    fix = ", ".join(
        f"{_clamp(_inf_null(c)) if c in ETL_CLAMP else _inf_null(c)} AS {c}" if c in num else c for c in cols)
    clean = f"""
e_dd AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY location, date ORDER BY _ord DESC) AS _rn
  FROM rolled) WHERE _rn = 1),
e_num AS (SELECT {fix} FROM e_dd WHERE date IS NOT NULL),
e_clean AS (SELECT {cap_iqr_sql(cols, ETL_NEW + ETL_TOTAL)} FROM e_num)"""
    imp = impute_ctes("e_clean", cols, ETL_STATIC, ETL_TOTAL, ETL_NEW, ETL_TOTAL, ETL_NEW + ETL_TOTAL, "ei")
    pc = [("total_cases", "total_cases_per_million", "1000000.0"), ("total_deaths", "total_deaths_per_million", "1000000.0"),
          ("new_cases", "new_cases_per_million", "1000000.0"), ("new_deaths", "new_deaths_per_million", "1000000.0"),
          ("total_tests", "total_tests_per_thousand", "1000.0"), ("new_tests", "new_tests_per_thousand", "1000.0")]
    pcs = ", ".join(f"{b} / nullif(population, 0) * {k} AS {p}" for b, p, k in pc)
    g2 = ["total_cases", "total_deaths"]
    gr_ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_wt(ROWS)}) AS _ff_{c}" for c in g2)
    gr_raw = ", ".join(f"(_ff_{c} / nullif(lag(_ff_{c}, 1) OVER ({_wt()}), 0) - 1.0) * 100.0 AS g_{c}" for c in g2)
    gr = ", ".join(f"CASE WHEN g_{c} IS NOT NULL THEN least(greatest(g_{c}, -1000.0), 1000.0) END AS {c}_growth_rate"
                   for c in g2)
    rt = (f"coalesce(CASE WHEN new_vaccinations IS NOT NULL THEN sum(new_vaccinations) OVER ({_wt(ROWS)}) END, 0.0) "
          f"AS total_vaccinations")
    feats = f"""
ef AS (SELECT *, {gr_ff} FROM ei5), eg AS (SELECT *, {gr_raw} FROM ef)"""
    return (f"{_with(NATION, _world_rollup(), clean, imp, feats)} SELECT {', '.join(cols)}, {pcs}, "
            f"total_deaths / nullif(total_cases, 0) * 100.0 AS case_fatality_rate, "
            f"new_cases / nullif(new_tests, 0) * 100.0 AS positive_rate, {gr}, {rt} FROM eg")


def oracle_sql() -> dict[str, str]:
    return {k: _wrap(k, v) for k, v in _sql().items()}
