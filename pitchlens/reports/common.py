"""Pieces several reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sides(match: DataFrame, *keep: str) -> DataFrame:
    """Two rows per match, one for each team, with ``is_home``, ``teamid`` and ``opponent``."""
    both = F.array(
        F.struct(
            F.lit(True).alias("is_home"),
            F.col("hometeam").alias("teamid"),
            F.col("guestteam").alias("opponent"),
        ),
        F.struct(
            F.lit(False).alias("is_home"),
            F.col("guestteam").alias("teamid"),
            F.col("hometeam").alias("opponent"),
        ),
    )
    return match.select("matchid", *keep, F.inline(both))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in ``order``, which must be total for the result to be fixed."""
    return df.orderBy(*order).limit(n)
