"""Registered queries: one per operator of the inventory, run on panels that
Spark derives from the TESTDATA tables (whole tables, no row caps).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose double
columns are rounded to 12 significant digits (summation order differs between engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelkit.functions import scalar as FS
from panelkit.operators import aggregates as A
from panelkit.operators import filters as P
from panelkit.operators import joins as J
from panelkit.operators import reshape as U
from panelkit.operators import segments as G
from panelkit.operators import stats as S
from panelkit.operators import windows as W
from panelkit.operators.profile import column_profile, dataset_metadata, metadata_document
from panelkit.plans import dashboard as D
from panelkit.plans import etl as X
from panelkit.plans import views as V
from panelkit.session import scratch_path
from panelkit.sources import fixtures as fx
from panelkit.sources import readers, sinks
from panelkit.spec import DEMOGRAPHIC_FACTORS, COVID_FACTORS, PanelSpec

SPEC = PanelSpec()
KEYED = PanelSpec(keyed=True)  # panels of fixtures.stored_keyed

# Query parameters (the features' inputs, not data filters).
COMPARE_ENTITIES = "NATION_1, nation_7 ,, Atlantis"
HISTORY_ENTITY = "nation_3"
LATEST_ENTITIES = " NATION_1, nation_7 ,, Europe "
EQ_ENTITIES = ["NATION_2", "EUROPE"]
SCORE_ENTITIES = ["NATION_0", "NATION_3", "NATION_5", "NATION_8", "NATION_11", "NATION_14", "NATION_20", "EUROPE"]
SCORE_METRICS = ["total_cases_per_million", "total_deaths_per_million", "gdp_per_capita", "median_age"]
OUTCOME = "total_deaths_per_million"
FACTORS = DEMOGRAPHIC_FACTORS + COVID_FACTORS
LABELS = {"total_cases_per_million": "Total Cases Per Million", "gdp_per_capita": "GDP Per Capita"}
METRIC_DIM = [
    ("total_cases_per_million", "Cases per million people"),
    ("total_deaths_per_million", "Deaths per million people"),
    ("case_fatality_rate", "Case fatality rate (%)"),
    ("gdp_per_capita", "Mean account balance"),
]


def sig_round(c: str) -> F.Column:
    """12 significant digits; Inf/NaN/0/null unchanged."""
    x = "`" + c.replace("`", "``") + "`"
    d = f"least(22, 11 - floor(log10(abs({x}))))"
    return F.expr(
        f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('inf') OR {x} = 0 THEN {x} "
        f"WHEN {d} >= 0 THEN round({x} * pow(10.0, {d}), 0) / pow(10.0, {d}) "
        f"ELSE round({x} / pow(10.0, -{d}), 0) * pow(10.0, -{d}) END")


def present(df: DataFrame) -> DataFrame:
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: sig_round(c) for c in fl}) if fl else df


def _ud(s, d):
    return fx.stored(s, d, "user_day")


def _td(s, d):
    return fx.stored(s, d, "type_day")


def _nd(s, d):
    return fx.stored(s, d, "nation_day")


def _nr(s, d):
    return fx.stored(s, d, "nation_raw")


def _nl(s, d):
    return fx.stored(s, d, "nation_latest")


def _cl(s, d):
    return fx.stored(s, d, "customer_latest")


def _er(s, d):
    return P.parse_dates(fx.stored(s, d, "event_reports"), SPEC)


def _cross(s, d, metric):
    return D.factor_rows(_nl(s, d), SPEC, metric)


# ---------------------------------------------------------------- sources / sinks

def q_scan_csv(s, d):
    p = scratch_path(s, "scan_csv")
    sinks.save_csv(_nd(s, d), p)
    return readers.scan_csv(s, p, SPEC, add_ord=False)


def q_scan_json(s, d):
    p = scratch_path(s, "scan_json")
    nd = _nd(s, d)
    sinks.save_json(nd, p)
    return readers.scan_json(s, p, SPEC, schema=nd.schema, add_ord=False).select(*nd.columns)


def q_sink_csv(s, d):
    ud = _ud(s, d)
    p = sinks.save_csv(ud, scratch_path(s, "sink_csv"))
    return s.read.option("header", True).schema(ud.schema).csv(p)


def q_sink_parquet(s, d):
    p = sinks.save_parquet(_ud(s, d), scratch_path(s, "sink_parquet"))
    return s.read.parquet(p)


def q_sink_json(s, d):
    ud = _ud(s, d)
    p = sinks.save_json(ud, scratch_path(s, "sink_json"))
    return s.read.schema(ud.schema).json(p)


def q_sink_partitioned(s, d):
    nd = _nd(s, d)
    p = sinks.save_by_entity(nd, SPEC, scratch_path(s, "by_entity"), fmt="parquet")
    return s.read.parquet(p).select(*nd.columns, F.col(sinks.PART_COL).cast("string").alias(sinks.PART_COL))


def q_parse_dates(s, d):
    raw = fx.stored(s, d, "event_reports").select("location", "_ord", F.col("date").alias("date_text"), "date")
    return P.parse_dates(raw, SPEC)


def q_load_stats(s, d):
    return A.load_stats(_nr(s, d), SPEC)


# ---------------------------------------------------------------- projections / filters

def q_project(s, d):
    return P.project(_nd(s, d), ["location", "date", "new_cases", "total_cases", "no_such_column"])


def q_select_numeric(s, d):
    return P.select_numeric(_ud(s, d), SPEC, exclude=["icu_patients"])


def q_drop_intermediate(s, d):
    t = W.moving_average(W.calendar_features(_td(s, d), SPEC), SPEC)
    return P.drop_intermediate(t)


def q_rename_labels(s, d):
    nl = _nl(s, d).select("location", "total_cases_per_million", "gdp_per_capita")
    return P.rename_labels(nl, LABELS)


def q_countries_only(s, d):
    return P.countries_only(_nr(s, d), SPEC)


def q_exclude_aggregates(s, d):
    return P.exclude_aggregates(_nl(s, d), SPEC)


def q_entity_history(s, d):
    return P.entity_history(fx.stored_keyed(s, d, "nation_raw"), KEYED, HISTORY_ENTITY)


def q_entities_in(s, d):
    return P.entities_in(fx.stored_keyed(s, d, "nation_latest"), KEYED, LATEST_ENTITIES)


def q_entity_eq(s, d):
    return P.entity_eq(_nr(s, d), SPEC, EQ_ENTITIES)


def q_date_range(s, d):
    return P.date_range(_td(s, d), SPEC, "2024-01-05", "2024-01-20")


def q_drop_nulls(s, d):
    return P.drop_nulls(_ud(s, d), ["total_deaths", "gdp_per_capita"])


def q_positive_only(s, d):
    return P.positive_only(_nl(s, d).select("location", "new_vaccinations"), "new_vaccinations")


def q_drop_bad_dates(s, d):
    return P.drop_bad_dates(_er(s, d), SPEC).select("location", "date", "_ord", "new_cases")


def q_iqr_trim(s, d):
    return _cross(s, d, "total_cases_per_million")


def q_iqr_trim_xy(s, d):
    nl = P.exclude_aggregates(_nl(s, d), SPEC).select("location", "continent", "gdp_per_capita", OUTCOME)
    return S.iqr_trim_xy(nl, "gdp_per_capita", OUTCOME)


def q_prune_null_columns(s, d):
    return P.prune_null_columns(_ud(s, d))


def q_head_sample(s, d):
    return P.head_sample(_nr(s, d), SPEC, 10)


def q_sanitize_output(s, d):
    return P.sanitize_output(_er(s, d).select("location", "_ord", "positive_rate", "new_cases"))


# ---------------------------------------------------------------- joins

def q_group_stat_join(s, d):
    return J.group_stat_join(_ud(s, d), SPEC, ["reproduction_rate", "stringency_index"], "median")


def q_metric_label_join(s, d):
    nl = P.exclude_aggregates(_nl(s, d), SPEC)
    long = U.unpivot_metrics(nl, ["location"], ["total_cases_per_million", "total_deaths_per_million",
                                                 "case_fatality_rate", "gdp_per_capita", "extreme_poverty"])
    dim = s.createDataFrame(METRIC_DIM, "metric string, label string")
    return J.metric_label_join(long, dim)


def q_entity_semi(s, d):
    wanted = s.createDataFrame([(t,) for t in LATEST_ENTITIES.split(",")], "name string")
    return J.entity_semi(_nr(s, d), SPEC, wanted)


def q_aggregate_anti(s, d):
    return J.aggregate_anti(_nl(s, d), SPEC)


def q_compare_timeseries(s, d):
    return V.compare_timeseries(fx.stored_keyed(s, d, "nation_raw"), KEYED, COMPARE_ENTITIES, "new_cases", "1996-01-01", "1996-03-31")


# ---------------------------------------------------------------- aggregations

def q_world_sum_by_date(s, d):
    return A.world_sum_by_date(_nr(s, d), SPEC)


def q_last_per_entity(s, d):
    return A.last_per_entity(_nr(s, d), SPEC)


def q_world_population(s, d):
    return A.world_statics(_nr(s, d), SPEC).select("population")


def q_weighted_mean_nonnull(s, d):
    return A.world_statics(_ud(s, d).withColumn("median_age", F.when(F.col("new_deaths") > 0, F.col("reproduction_rate"))), SPEC,
                           weight_nonnull_only=True)


def q_weighted_mean(s, d):
    return A.world_statics(_nr(s, d), SPEC)


def q_world_rollup(s, d):
    return A.world_rollup(_nr(s, d), SPEC)


def q_latest_per_entity(s, d):
    return V.latest(_nr(s, d), SPEC)


def q_dedupe_last(s, d):
    return A.dedupe_last(_er(s, d), SPEC)


def q_dedupe_rows(s, d):
    return A.dedupe_rows(_er(s, d).select("location", "continent", "date", "_ord"), SPEC)


def q_entity_list(s, d):
    return A.entity_list(_nr(s, d), SPEC)


def q_entity_selector(s, d):
    return A.entity_selector(_nr(s, d), SPEC)


def q_bad_date_sample(s, d):
    raw = fx.stored(s, d, "event_reports").withColumn("date_text", F.col("date"))
    return P.bad_date_sample(P.parse_dates(raw, SPEC), SPEC, "date_text")


def q_materialize(s, d):
    return sinks.materialize(readers.require_rows(_ud(s, d), "user_day"), scratch_path(s, "materialize"))


def q_save_all_formats(s, d):
    nd = _nd(s, d)
    out = sinks.save_all_formats(nd, SPEC, scratch_path(s, "all_formats"), "panel")
    back = {"csv": s.read.option("header", True).schema(nd.schema).csv(out["csv"]),
            "json": s.read.schema(nd.schema).json(out["json"]), "parquet": s.read.parquet(out["parquet"])}
    one = [df.agg(F.lit(k).alias("format"), F.count(F.lit(1)).alias("rows"), F.count_distinct("location").alias("entities"),
                  F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("new_cases").alias("values"))
           for k, df in back.items()]
    return one[0].unionByName(one[1]).unionByName(one[2])


def q_compare_nested(s, d):
    n = V.compare_timeseries_nested(fx.stored_keyed(s, d, "nation_raw"), KEYED, COMPARE_ENTITIES, "new_cases", "1996-01-01", "1996-03-31")
    return n.select("entity", F.size("series").alias("points"), F.posexplode_outer("series")).select(
        "entity", "points", F.col("pos"), F.col("col.date").alias("date"), F.col("col.value").alias("value"))


def q_entity_count(s, d):
    return A.entity_count(_nr(s, d), SPEC)


def q_entity_count_approx(s, d):
    exact, approx = A.entity_count(_cl(s, d), SPEC), A.entity_count(_cl(s, d), SPEC, approx=True).withColumnRenamed("entities", "_a")
    near = F.abs(F.col("_a") - F.col("entities")) <= 0.15 * F.col("entities")  # three standard deviations of the sketch
    return J.join_one_row(exact, approx).select("entities", near.alias("near"))


def q_date_bounds(s, d):
    return A.date_bounds(_ud(s, d), SPEC)


def q_null_counts(s, d):
    return A.null_counts(_ud(s, d))


def q_group_rollup_share(s, d):
    return D.group_overview(_nl(s, d), SPEC, "total_cases")


PERIOD_METRICS = ["new_cases", "new_deaths", "total_cases", "total_deaths", "stringency_index"]
PERIOD_LABELS = [("new_cases", "Events a day"), ("total_cases", "Events so far"), ("stringency_index", "Highest value")]


def q_period_view(s, d):
    labels = s.createDataFrame(PERIOD_LABELS, "metric string, label string")
    return D.period_view(_ud(s, d), SPEC, PERIOD_METRICS, labels, "2024-01-05", "2024-01-25")


def q_period_series(s, d):
    return D.period_analysis(_ud(s, d), SPEC, PERIOD_METRICS, "2024-01-05", "2024-01-25")


def q_entity_moving_average(s, d):
    m = W.moving_average(fx.stored_keyed(s, d, "type_day"), KEYED)
    return P.entity_rows(m, KEYED, ["CLICK"]).drop(KEYED.ekey)


def q_latest_for(s, d):
    return V.latest(fx.stored_keyed(s, d, "nation_raw"), KEYED, LATEST_ENTITIES)


def q_materialize_bucketed(s, d):
    path = scratch_path(s, "bucketed")
    t = sinks.materialize_bucketed(_td(s, d), SPEC, "panel_" + path.rsplit("-", 1)[1], path, buckets=8)
    return W.moving_average(W.days_since_first(t, SPEC), SPEC, ["new_cases"])


def q_scan_csv_files(s, d):
    raw = fx.stored(s, d, "event_reports")
    p = scratch_path(s, "scan_csv_files")
    sinks.save_csv(raw.repartitionByRange(5, "_ord").sortWithinPartitions("_ord").drop("_ord"), p)
    schema = ", ".join(f"{n} {'string' if n in ('location', 'date') else t}" for n, t in raw.drop("_ord").dtypes)
    found = A.dedupe_last(readers.scan_csv(s, p, SPEC, schema=schema), SPEC)
    return found.select("location", "date", "_ord", "new_cases", "hosp_patients")


def q_metadata_document(s, d):
    ud, p = _ud(s, d), scratch_path(s, "metadata")
    sinks.save_json(metadata_document(ud, SPEC, {"origin": "events", "grain": "day"}), p)
    schema = metadata_document(ud, SPEC).schema
    m = s.read.schema(schema).option("dateFormat", "yyyy-MM-dd").json(p)
    return m.select("total_rows", "total_columns", F.col("date_range.start").alias("date_start"), F.col("date_range.end").alias("date_end"),
                    "locations", "data_types", F.col("custom")["origin"].alias("origin"), F.size("custom").alias("custom_entries"),
                    F.posexplode("columns").alias("place", "column")).withColumn("type", F.col("data_types")[F.col("column")]).drop("data_types")


def q_audit_samples(s, d):
    ud = _ud(s, d)
    cl = X.clean_pipeline(ud, SPEC).df
    return D.audit_samples({"raw": ud, "cleaned": cl}, SPEC, ["new_cases", "total_cases", "icu_patients"], 5)


def q_audit_reports(s, d):
    return D.audit_reports({"clean": X.clean_pipeline(_er(s, d), SPEC), "impute": X.impute_pipeline(_ud(s, d), SPEC)})


def q_period_flow_kpis(s, d):
    return A.period_flow_kpis(_td(s, d), SPEC, "new_tests", "2024-01-08", "2024-01-21")


def q_period_stock_kpis(s, d):
    return A.period_stock_kpis(_ud(s, d), SPEC, "total_deaths", "2024-01-05", "2024-01-25")


def q_global_kpis(s, d):
    lat = A.latest_per_entity(A.world_rollup(_nr(s, d), SPEC), SPEC)
    return D.kpi_strip(lat, SPEC)


def q_world_pop_fallback(s, d):
    return A.world_pop_fallback(_nl(s, d), SPEC)


def q_entity_context(s, d):
    return A.entity_context(_nr(s, d), SPEC)


def q_describe_metric(s, d):
    return S.describe_metric(_cross(s, d, "total_cases_per_million"), "total_cases_per_million")


def q_nearest_to_center(s, d):
    rows = _cross(s, d, "total_cases_per_million")
    return S.nearest_to_center(rows, rows, "location", "total_cases_per_million")


def q_histogram(s, d):
    return S.histogram(_cross(s, d, "gdp_per_capita"), "gdp_per_capita")


def q_box_stats(s, d):
    return S.box_stats(_cross(s, d, "total_cases_per_million"), "total_cases_per_million", "continent")


def q_spearman(s, d):
    return S.spearman(P.exclude_aggregates(_nl(s, d), SPEC), "location", OUTCOME, FACTORS)


def q_topk_correlation(s, d):
    return D.factor_correlations(_nl(s, d), SPEC, OUTCOME, FACTORS)


def q_ols_by_group(s, d):
    return D.factor_scatter_fit(_nl(s, d), SPEC, "gdp_per_capita", OUTCOME)


def q_dataset_metadata(s, d):
    return dataset_metadata(_ud(s, d), SPEC)


def q_column_profile(s, d):
    return column_profile(_ud(s, d), SPEC)


def q_minmax_score(s, d):
    return S.minmax_score(P.exclude_aggregates(_nl(s, d), SPEC), "location", SCORE_METRICS)


def q_cleaning_report(s, d):
    return X.clean_pipeline(_er(s, d), SPEC).report()


def q_imputation_report(s, d):
    return X.impute_pipeline(_ud(s, d), SPEC).report()


# ---------------------------------------------------------------- one row a customer: a cross-section that grows with the input

BALANCE = "extreme_poverty"  # balance less all orders: large and negative
CUSTOMER_FACTORS = ["gdp_per_capita", "population_density", "life_expectancy", "median_age"]


def q_customer_rank(s, d):
    return S.average_rank(_cl(s, d).select("location", BALANCE), [], BALANCE)


def q_customer_rank_by_nation(s, d):
    return S.average_rank(_cl(s, d).select("location", "continent", "total_cases"), ["continent"], "total_cases")


def q_customer_trim(s, d):
    return D.factor_rows(_cl(s, d), SPEC, BALANCE)


def q_customer_trim_by_nation(s, d):
    return S.iqr_trim(_cl(s, d).select("location", "continent", BALANCE), BALANCE, factor=0.5, keys=["continent"])


def q_customer_trim_xy(s, d):
    return S.iqr_trim_xy(_cl(s, d).select("location", "continent", BALANCE, "median_age"), BALANCE, "median_age")


def q_customer_describe(s, d):
    return S.describe_metric(_cl(s, d), BALANCE)


def q_customer_describe_by_nation(s, d):
    return S.describe_metric(_cl(s, d), BALANCE, ["continent"])


def q_customer_nearest(s, d):
    return S.nearest_to_center(_cl(s, d), _cl(s, d), "location", BALANCE)


def q_customer_histogram(s, d):
    return S.histogram(D.factor_rows(_cl(s, d), SPEC, BALANCE), BALANCE)


def q_customer_box(s, d):
    return S.box_stats(_cl(s, d), BALANCE, "continent")


def q_box_outliers(s, d):
    return S.box_outliers(_cl(s, d), "location", "total_tests", "continent", factor=1.0)


def q_customer_spearman(s, d):
    return S.spearman(_cl(s, d), "location", BALANCE, CUSTOMER_FACTORS)


def q_customer_ols(s, d):
    return D.factor_scatter_fit(_cl(s, d), SPEC, BALANCE, "gdp_per_capita")


def q_customer_profile(s, d):
    return column_profile(_cl(s, d), SPEC)


def q_factor_study_full(s, d):
    return D.factor_study(_cl(s, d), SPEC, "gdp_per_capita")


def q_factor_study_log(s, d):
    return D.factor_study(_cl(s, d), SPEC, "gdp_per_capita", log_scale=True, include_outliers=True)


# ---------------------------------------------------------------- segmented windows (small segments, so that entities are cut)

def q_segmented_static_fill(s, d):
    return G.static_fill(_ud(s, d), SPEC, rows=500)


def q_segmented_forward_fill(s, d):
    return G.forward_fill(_ud(s, d), SPEC, rows=500)


def q_segmented_running_total(s, d):
    return G.running_total(_ud(s, d).drop("total_cases", "total_deaths"), SPEC, rows=500)


def q_segmented_moving_average(s, d):
    return G.moving_average(_td(s, d), SPEC, rows=20)


def q_segmented_interpolate(s, d):
    return G.interpolate_bounded(_ud(s, d), SPEC, rows=500)


def q_segmented_fill_median(s, d):
    return G.fill_statistic(_ud(s, d), SPEC)


def q_segmented_cap_iqr(s, d):
    return G.cap_iqr(_td(s, d), SPEC)


# ---------------------------------------------------------------- windows

def q_static_fill(s, d):
    return W.static_fill(_ud(s, d), SPEC)


def q_forward_fill(s, d):
    return W.forward_fill(_ud(s, d), SPEC)


def q_zero_fill(s, d):
    return W.zero_fill(_ud(s, d), SPEC)


def q_interpolate_bounded(s, d):
    return W.interpolate_bounded(_ud(s, d), SPEC)


def q_fill_median(s, d):
    return W.fill_statistic(_ud(s, d), SPEC, method="median")


def q_fill_mean(s, d):
    return W.fill_statistic(_ud(s, d), SPEC, method="mean")


def q_cap_iqr(s, d):
    return W.cap_iqr(_td(s, d), SPEC)


def q_cap_zscore(s, d):
    return W.cap_zscore(_ud(s, d), SPEC)


def q_moving_average(s, d):
    return W.moving_average(_td(s, d), SPEC)


def q_centered_average(s, d):
    return W.centered_average(_ud(s, d), SPEC, ["new_cases", "reproduction_rate"])


def q_growth_rate(s, d):
    return W.growth_rate(_ud(s, d), SPEC)


def q_lag_features(s, d):
    return W.lag_features(_ud(s, d), SPEC)


def q_running_total(s, d):
    return W.running_total(_ud(s, d).drop("total_cases", "total_deaths"), SPEC)


def q_first_difference(s, d):
    return W.first_difference(_ud(s, d), SPEC)


def q_days_since_first(s, d):
    return W.days_since_first(_ud(s, d), SPEC)


def q_average_rank(s, d):
    nl = P.exclude_aggregates(_nl(s, d), SPEC).select("location", "new_cases")
    return S.average_rank(nl, [], "new_cases")


def q_calendar_features(s, d):
    return W.calendar_features(_td(s, d), SPEC)


# ---------------------------------------------------------------- sorts

def q_sorted_panel(s, d):
    return _td(s, d).orderBy("location", "date", "_ord")


def q_compare_bar(s, d):
    return D.compare_bar(_nl(s, d), SPEC, SCORE_ENTITIES, "total_cases_per_million")


def q_recent_first(s, d):
    return P.entity_history(fx.stored_keyed(s, d, "type_day"), KEYED, "Click").orderBy(F.col("date").desc())


# ---------------------------------------------------------------- set / reshape

def q_union_by_name(s, d):
    world = A.world_sum_by_date(_nr(s, d), SPEC).withColumn("location", F.lit("World"))
    return U.union_by_name(_nd(s, d), world)


def q_unpivot_scores(s, d):
    nl = P.entity_eq(P.exclude_aggregates(_nl(s, d), SPEC), SPEC, SCORE_ENTITIES)
    return U.unpivot_metrics(nl, ["location"], SCORE_METRICS)


def q_pivot_scores(s, d):
    sc = D.compare_scores(_nl(s, d), SPEC, SCORE_ENTITIES, SCORE_METRICS)
    return U.pivot_metric_by_entity(sc, "location", "score", [e for e in SCORE_ENTITIES if e.upper() != "EUROPE"])


def q_records_json(s, d):
    return U.records_json(V.latest(_nr(s, d), SPEC))


def q_records_json_parsed(s, d):
    rows = V.latest(_nr(s, d), SPEC)
    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return U.records_json(rows).select(F.from_json("record", ddl, {"dateFormat": "yyyy-MM-dd"}).alias("r")).select("r.*")


# ---------------------------------------------------------------- scalars

def q_safe_division(s, d):
    ud = _ud(s, d)
    return ud.select("location", "date",
                     FS.safe_div("new_deaths", "new_cases", 100.0).alias("purchase_share"),
                     FS.safe_div("total_deaths", "new_deaths").alias("stock_per_flow"))


def q_inf_to_null(s, d):
    return _er(s, d).select("location", "_ord", FS.inf_to_null("positive_rate").alias("positive_rate"))


def q_clamp_negative(s, d):
    return _er(s, d).select("location", "_ord", FS.clamp_negative("new_deaths").alias("new_deaths"))


def q_rate_features(s, d):
    return X.rate_features(_ud(s, d))


def q_per_capita(s, d):
    return X.per_capita(_ud(s, d), SPEC)


def q_format_number_text(s, d):
    nl = _nl(s, d)
    return nl.select("location", *[FS.format_big_number(c).alias(f"{c}_text")
                                   for c in ["total_tests", "population", "gdp_per_capita", "extreme_poverty", "new_cases"]])


def q_date_text(s, d):
    return _td(s, d).select("location", "date", FS.date_text("date").alias("date_text"))


def q_log_metric(s, d):
    return _nl(s, d).select("location", FS.log_metric("new_vaccinations").alias("log_new_vaccinations"))


# ---------------------------------------------------------------- pipelines

def q_clean_pipeline(s, d):
    return X.clean_pipeline(_er(s, d), SPEC).df


def q_impute_pipeline(s, d):
    return X.impute_pipeline(_ud(s, d), SPEC).df


def q_feature_pipeline(s, d):
    return X.feature_pipeline(_ud(s, d), SPEC)


def q_etl_pipeline(s, d):
    return X.etl_pipeline(_nr(s, d), SPEC).df


def q_map_feed(s, d):
    return D.map_feed(_nl(s, d), SPEC, "total_cases")


def q_period_analysis(s, d):
    return D.period_analysis(_td(s, d), SPEC, "new_cases", "2024-01-03", "2024-01-27")


def q_compare_scores(s, d):
    return D.compare_scores(_nl(s, d), SPEC, SCORE_ENTITIES, SCORE_METRICS)


def q_factor_study(s, d):
    return D.factor_summary(_nl(s, d), SPEC, "total_cases_per_million")


def q_pipeline_audit(s, d):
    ud = _ud(s, d)
    cl = X.clean_pipeline(ud, SPEC).df
    im = X.impute_pipeline(cl, SPEC).df
    return D.pipeline_audit({"raw": ud, "cleaned": cl, "imputed": im})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k[2:]: v for k, v in sorted(globals().items()) if k.startswith("q_") and callable(v)
}
# Keys whose names differ from the function names above.
QUERIES["sink_csv_roundtrip"] = QUERIES.pop("sink_csv")
QUERIES["sink_parquet_roundtrip"] = QUERIES.pop("sink_parquet")
QUERIES["sink_json_roundtrip"] = QUERIES.pop("sink_json")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda f: (lambda spark, sf_dir: present(f(spark, sf_dir))))(f) for k, f in QUERIES.items()}
