"""Panel description and the fixed name lists the operators default to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

# ---------------------------------------------------------------------------
# Fixed values (must equal the surveyed system's lists for identical results)
# ---------------------------------------------------------------------------

# Source aggregate names excluded from cross-sections (compared lower-case).
AGGREGATE_NAMES = [
    "world", "europe", "asia", "africa", "north america", "south america", "oceania",
    "european union", "high income", "upper middle income", "lower middle income", "low income",
]

# Per-entity attributes that do not change day to day.
STATIC_COLUMNS = [
    "population", "population_density", "median_age", "aged_65_older",
    "aged_70_older", "gdp_per_capita", "extreme_poverty",
    "cardiovasc_death_rate", "diabetes_prevalence", "female_smokers",
    "male_smokers", "handwashing_facilities", "hospital_beds_per_thousand",
    "life_expectancy", "human_development_index",
]

# Columns summed per date for the world row.
WORLD_SUM_COLUMNS = [
    "total_cases", "new_cases", "total_deaths", "new_deaths",
    "total_tests", "new_tests", "total_vaccinations", "new_vaccinations",
    "people_vaccinated", "people_fully_vaccinated", "total_boosters",
    "hosp_patients", "icu_patients",
]

# Columns averaged for the world row, weighted by population.
WORLD_WEIGHTED_COLUMNS = [
    "median_age", "aged_65_older", "aged_70_older", "gdp_per_capita",
    "extreme_poverty", "cardiovasc_death_rate", "diabetes_prevalence",
    "female_smokers", "male_smokers", "handwashing_facilities",
    "hospital_beds_per_thousand", "life_expectancy", "human_development_index",
]

# Labels of the world row.
WORLD_ENTITY = "World"
WORLD_CODE = "OWID_WRL"
WORLD_GROUP = "Global"

# Columns never capped as outliers (statics, id, calendar).
OUTLIER_EXCLUDE = ["iso_code"] + STATIC_COLUMNS + [
    "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
]

# Columns never interpolated / median-filled.
IMPUTE_STATIC_EXCLUDE = ["iso_code"] + STATIC_COLUMNS

# Columns kept by the null-ratio pruning whatever their null share.
ESSENTIAL_COLUMNS = ["location", "date", "iso_code", "continent", "population"]

# Name fragments of columns that cannot be negative.
NON_NEGATIVE_KEYWORDS = ["total", "new", "people", "population", "hosp", "icu"]

# Feature engineering inputs.
FLOW_FEATURE_COLUMNS = ["new_cases", "new_deaths", "new_tests", "new_vaccinations"]
GROWTH_COLUMNS = ["total_cases", "total_deaths", "total_vaccinations"]
DIFFERENCE_COLUMNS = ["new_cases", "new_deaths"]
RUNNING_TOTAL_MAP = {
    "new_cases": "total_cases",
    "new_deaths": "total_deaths",
    "new_tests": "total_tests",
    "new_vaccinations": "total_vaccinations",
}
CALENDAR_COLUMNS = ["year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend"]

# Intermediate feature columns dropped at the end of the feature pipeline.
INTERMEDIATE_FEATURES = [
    "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
    "days_since_first_case", "Days Since First Case",
    "new_cases_lag1", "new_cases_lag7", "new_cases_lag14",
    "new_deaths_lag1", "new_deaths_lag7", "new_deaths_lag14",
    "new_tests_lag1", "new_tests_lag7", "new_tests_lag14",
    "new_vaccinations_lag1", "new_vaccinations_lag7", "new_vaccinations_lag14",
    "New Cases Lag1", "New Cases Lag7", "New Cases Lag14",
    "New Deaths Lag1", "New Deaths Lag7", "New Deaths Lag14",
    "new_cases_diff", "new_deaths_diff",
    "new_cases_ma7", "new_cases_ma14",
    "new_deaths_ma7", "new_deaths_ma14",
    "new_tests_ma7", "new_tests_ma14",
    "new_vaccinations_ma7", "new_vaccinations_ma14",
    "New Cases Ma7", "New Deaths Ma7",
    "New People Vaccinated Smoothed",
    "New People Vaccinated Smoothed Per Hundred",
]

# Score direction lists for the normalised comparison.
HIGHER_IS_BETTER = [
    "people_vaccinated_per_hundred", "people_fully_vaccinated_per_hundred", "total_boosters_per_hundred",
    "total_vaccinations_per_hundred", "total_tests_per_thousand", "gdp_per_capita",
    "handwashing_facilities", "hospital_beds_per_thousand", "life_expectancy", "human_development_index",
]
LOWER_IS_BETTER = [
    "total_cases_per_million", "total_deaths_per_million", "case_fatality_rate", "positive_rate",
    "icu_patients_per_million", "hosp_patients_per_million", "extreme_poverty",
    "cardiovasc_death_rate", "diabetes_prevalence", "female_smokers", "male_smokers",
]

# Factors correlated against an outcome.
DEMOGRAPHIC_FACTORS = [
    "population_density", "median_age", "aged_65_older", "aged_70_older",
    "gdp_per_capita", "extreme_poverty", "cardiovasc_death_rate",
    "diabetes_prevalence", "female_smokers", "male_smokers",
    "handwashing_facilities", "hospital_beds_per_thousand",
    "life_expectancy", "human_development_index",
]
COVID_FACTORS = ["people_fully_vaccinated_per_hundred", "positive_rate", "stringency_index", "reproduction_rate"]

# Metrics counted per day: a period is summed, not compared at its ends (with the intermediate features above).
FLOW_METRICS = [
    "new_cases", "new_deaths", "new_tests", "new_vaccinations",
    "new_cases_smoothed", "new_deaths_smoothed", "new_tests_smoothed", "new_vaccinations_smoothed",
    "new_cases_per_million", "new_deaths_per_million", "new_cases_smoothed_per_million",
    "new_deaths_smoothed_per_million", "weekly_icu_admissions", "weekly_hosp_admissions",
    "weekly_icu_admissions_per_million", "weekly_hosp_admissions_per_million",
]
# Attributes shown beside an entity.
CONTEXT_COLUMNS = ["population", "gdp_per_capita", "median_age", "life_expectancy"]

# Derived columns: result, numerator, denominator, factor, only where the result is absent.
RATES = [
    ("case_fatality_rate", "total_deaths", "total_cases", 100.0, False),
    ("positive_rate", "new_cases", "new_tests", 100.0, True),
    ("vaccination_coverage", "people_fully_vaccinated", "population", 100.0, False),
    ("icu_to_hospitalized_ratio", "icu_patients", "hosp_patients", 100.0, False),
]
PER_CAPITA = [
    ("total_cases_per_million", "total_cases", 1e6),
    ("total_deaths_per_million", "total_deaths", 1e6),
    ("new_cases_per_million", "new_cases", 1e6),
    ("new_deaths_per_million", "new_deaths", 1e6),
    ("total_tests_per_thousand", "total_tests", 1e3),
    ("new_tests_per_thousand", "new_tests", 1e3),
]

# Analysis defaults.
NULL_THRESHOLD = 0.5
IQR_CAP_FACTOR = 3.0
TRIM_FACTOR = 1.5
INTERPOLATION_LIMIT = 7
MA_WINDOWS = (7, 14)
LAGS = (1, 7, 14)
GROWTH_PERIODS = 1
GROWTH_CLIP = 1000.0
HISTOGRAM_BINS = 50
TOP_K = 15
MIN_CORRELATION_ROWS = 10
CENTERED_WINDOW = 7
DEFAULT_START_DATE = "2020-01-22"


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key columns of a panel.

    ``entity`` and ``time`` form the logical key; ``ord`` is the source
    ordinal that breaks ties the way row order does in a data frame. ``ekey``
    is the stored lower-case entity of panels written by ``sinks.store_keyed``
    (``keyed``: this panel has it).
    """

    entity: str = "location"
    time: str = "date"
    group: str | None = "continent"
    code: str | None = "iso_code"
    ord: str = "_ord"
    weight: str = "population"
    ekey: str = "_ekey"
    keyed: bool = False
    extra_keys: tuple[str, ...] = field(default_factory=tuple)

    @property
    def partition(self) -> list[str]:
        """What per-entity windows are partitioned by; with the stored key column, a filter on it sinks below them to the scan."""
        return [self.ekey, self.entity] if self.keyed else [self.entity]

    @property
    def keys(self) -> list[str]:
        ks = [self.entity, self.time, self.group, self.code, self.ord, self.ekey, *self.extra_keys]
        return [k for k in ks if k]

    def with_(self, **kw) -> "PanelSpec":
        return replace(self, **kw)

    def numeric_columns(self, df: DataFrame, exclude=()) -> list[str]:
        """Numeric metric columns (keys and ``exclude`` removed), in schema order."""
        skip = set(self.keys) | set(exclude)
        return [
            f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip
        ]

    def date_columns(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields
                if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]

