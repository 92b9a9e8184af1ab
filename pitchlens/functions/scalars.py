"""Column expressions shared by the operators; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str

DAY_PATTERN = "d.M.yyyy"

# Position name -> kind of position. The centre forward is listed under midfield.
POSITION_KINDS: dict[str, str] = {
    "Abwehr": "Abwehr",
    "Mittelfeld": "Mittelfeld",
    "Sturm": "Sturm",
    "Torwart": "Torwart",
    "Defensives Mittelfeld": "Mittelfeld",
    "Hängende Spitze": "Sturm",
    "Innenverteidiger": "Abwehr",
    "Libero": "Abwehr",
    "Linker Verteidiger": "Abwehr",
    "Linksaußen": "Sturm",
    "Mittelstürmer": "Mittelfeld",
    "Offensives Mittelfeld": "Mittelfeld",
    "Rechter Verteidiger": "Abwehr",
    "Rechtes Mittelfeld": "Mittelfeld",
    "Rechtsaußen": "Sturm",
    "Zentrales Mittelfeld": "Mittelfeld",
    "Linkes Mittelfeld": "Mittelfeld",
}


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day(text: ColumnLike) -> Column:
    """Text day.month.year, with or without leading zeros, to a date; NULL if it is none."""
    return F.try_to_timestamp(_col(text), F.lit(DAY_PATTERN)).cast("date")


def minute_of_text(text: ColumnLike) -> Column:
    """Text to minute; NULL for anything but a whole number, such as '45+2'."""
    return _col(text).try_cast("int")


# Fixed value: how whole numbers are written; ids come both as '12' and '12.0'.
WHOLE_NUMBER = r"^\s*[+-]?\d+(\.0*)?\s*$"


def number_of_text(text: ColumnLike) -> Column:
    """Text to whole number, exact over the whole range of a bigint; NULL for anything else, such as '12.7'."""
    digits = F.regexp_replace(F.trim(_col(text)), r"\.0*$", "")
    return F.when(_col(text).rlike(WHOLE_NUMBER), digits.try_cast("bigint"))


def playtime(in_time: ColumnLike, out_time: ColumnLike) -> Column:
    """Minutes on the pitch; 1 where both ends are equal or one is unknown."""
    span = _col(out_time) - _col(in_time)
    return F.when(_col(out_time) != _col(in_time), span).otherwise(1).cast("int")


def match_points(goals: ColumnLike, goals_against: ColumnLike) -> Column:
    """3 for a win, 1 for a draw, 0 for a defeat."""
    own, other = _col(goals), _col(goals_against)
    return F.when(own > other, 3).when(own < other, 0).otherwise(1)


def age_years(day: ColumnLike, birthdate: ColumnLike) -> Column:
    return F.datediff(_col(day), _col(birthdate)) / F.lit(365)


def per_minute(total: ColumnLike, minutes: ColumnLike) -> Column:
    return F.try_divide(_col(total), _col(minutes))


def month_of(day: ColumnLike) -> Column:
    return F.trunc(_col(day), "month")


def year_of(day: ColumnLike) -> Column:
    return F.trunc(_col(day), "year")


def position_kind(position: ColumnLike) -> Column:
    """Kind of a position, NULL for positions outside the fixed list."""
    pairs = [F.lit(text) for pair in POSITION_KINDS.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), _col(position))


def dedupe(df: DataFrame) -> DataFrame:
    """Exact copies collapsed, as raw dumps repeat rows."""
    return df.dropDuplicates()
