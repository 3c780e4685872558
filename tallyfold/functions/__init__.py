from .bands import age_band, bin_half_open, label_by_rules, ordinal_lookup, three_bands
from .dates import add_days, age_years, day_diff, midpoint, parse_date
from .numbers import (
    exact_amount, mean, narrow_to_byte, narrow_to_short, number, parse_number, ratio, round_half_up,
    safe_ratio, strip_separators, total, zero_to_null,
)
from .text import contains_all, excludes_all, normalize_text, starts_with

__all__ = [
    "add_days", "age_band", "age_years", "bin_half_open", "contains_all", "day_diff", "exact_amount", "excludes_all",
    "label_by_rules", "mean", "midpoint", "narrow_to_byte", "narrow_to_short",
    "normalize_text", "number", "ordinal_lookup", "parse_date", "parse_number", "ratio", "round_half_up",
    "safe_ratio", "starts_with", "strip_separators", "three_bands", "total", "zero_to_null",
]
