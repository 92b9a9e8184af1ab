from pitchlens.functions.scalars import (
    age_years,
    match_points,
    minute_of_text,
    month_of,
    number_of_text,
    parse_day,
    per_minute,
    playtime,
    position_kind,
    year_of,
)

__all__ = [
    "age_years",
    "match_points",
    "minute_of_text",
    "month_of",
    "number_of_text",
    "parse_day",
    "per_minute",
    "playtime",
    "position_kind",
    "year_of",
]
