"""Scalar column expressions (F1-F16). All are JVM built-ins, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, k: float = 1.0) -> Column:
    """``num/den*k``; null when either side is null or the denominator is 0."""
    return F.try_divide(_c(num), _c(den)) * F.lit(k)


def is_inf_or_nan(c) -> Column:
    c = _c(c)
    return F.isnan(c) | (F.abs(c) == F.lit(INF))


def inf_to_null(c) -> Column:
    """F2/P20: +-Inf and NaN become null."""
    c = _c(c)
    return F.when(~is_inf_or_nan(c), c)


def clamp_negative(c) -> Column:
    """negatives become 0, null stays null."""
    c = _c(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def clip_keep_null(c, lo: float, hi: float) -> Column:
    """clip into [lo, hi]; ``greatest``/``least`` skip nulls, so null is guarded."""
    c = _c(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def sign_label(c) -> Column:
    """'positive' when > 0, otherwise (including NaN/null) 'negative'."""
    c = _c(c)
    return F.when(c > 0, F.lit("positive")).otherwise(F.lit("negative"))


def label_fallback(name) -> Column:
    """``_`` -> space, then title case: a letter is upper-case after a non-letter, else lower-case."""
    text = F.lower(F.regexp_replace(_c(name), "_", " "))
    # runs of letters and runs of other characters, each run of letters capitalised
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)")), F.initcap), "")


def date_text(c) -> Column:
    """ISO ``yyyy-MM-dd`` text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def parse_date(c, fmt: str | None = None) -> Column:
    """text/timestamp -> date, unparsable -> null (ANSI-safe)."""
    c = _c(c)
    ts = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return F.to_date(ts)


def log_metric(c) -> Column:
    """F16: base-10 log for the log axis, defined only for positive values."""
    c = _c(c)
    return F.when(c > 0, F.log10(c))


def format_big_number(c) -> Column:
    """N/A, B (2 dp), M (2 dp), K (1 dp), |x|<10 (1 dp), else thousands separator.

    ``format_number`` rounds the binary value half-even; the scaled texts and
    those below 10 have no thousands separator.
    """
    c = _c(c)
    a = F.abs(c)
    fixed = lambda x, places: F.replace(F.format_number(x, places), F.lit(","), F.lit(""))
    return (
        F.when(c.isNull() | F.isnan(c), F.lit("N/A"))
        .when(a >= 1e9, F.concat(fixed(c / 1e9, 2), F.lit(" B")))
        .when(a >= 1e6, F.concat(fixed(c / 1e6, 2), F.lit(" M")))
        .when(a >= 1e3, F.concat(fixed(c / 1e3, 1), F.lit(" K")))
        .when((a < 10) & (c != 0), fixed(c, 1))
        .otherwise(F.format_number(c, 0))
    )


def non_negative_name(name: str, keywords) -> bool:
    """Driver-side name test for F3 (substring match, lower-case)."""
    low = name.lower()
    return any(k in low for k in keywords)
