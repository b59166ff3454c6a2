"""Scalar Column helpers (names, percentages, splitting, ranges)."""

from podium.functions.text import (
    after_first_word,
    concat_nulls_as_empty,
    first_word,
    full_name,
    hundredths_of_percent,
    idiv,
    nth_part,
    percent_text_fixed,
    percent_text_trimmed,
    strict_name,
    time_text,
    whole_percent,
    year_range,
)

__all__ = [
    "after_first_word", "concat_nulls_as_empty", "first_word", "full_name",
    "hundredths_of_percent", "idiv", "nth_part", "percent_text_fixed",
    "percent_text_trimmed", "strict_name", "time_text", "whole_percent", "year_range",
]
