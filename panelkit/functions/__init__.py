from panelkit.functions.scalar import (  # noqa: F401
    clamp_negative, clip_keep_null, date_text, format_big_number, inf_to_null,
    is_inf_or_nan, label_fallback, log_metric, parse_date, safe_div, sign_label,
)
