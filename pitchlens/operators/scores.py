"""The score set: rolling totals and averages for several X, with the player's age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import DEFAULT_XS
from pitchlens.functions.scalars import age_years
from pitchlens.operators.neutral import neutral_points
from pitchlens.operators.rolling import last_x
from pitchlens.schema import Tables
from pitchlens.skew import HotKeys, split_join


def score_set(tables: Tables, xs: Sequence[int] = DEFAULT_XS) -> DataFrame:
    """One wide row per player, match and team; all X come from the same two windows."""
    return last_x(neutral_points(tables), xs, hot=tables.hot_players)


def score_latest(scores: DataFrame) -> DataFrame:
    """The latest row per player and match, ties kept."""
    newest = W.partitionBy("playerid", "matchid").orderBy(F.desc("target_match_timestamp"))
    return scores.withColumn("_rank", F.rank().over(newest)).filter("_rank = 1").drop("_rank")


def with_age(scores: DataFrame, profile: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add age in years at the match; NULL for players without a known birth date."""
    born = profile.filter(F.col("birthdate").isNotNull()).select("playerid", "birthdate")
    joined = split_join(scores, born, ["playerid"], "left", hot=hot, spread_by=["matchid"])
    return joined.withColumn("age", age_years("target_match_timestamp", "birthdate")).drop(
        "birthdate"
    )


def score_with_age(tables: Tables, xs: Sequence[int] = DEFAULT_XS) -> DataFrame:
    """The complete score table, as the batch job stores it."""
    scores = score_latest(score_set(tables, xs))
    return with_age(scores, tables.profile, hot=tables.hot_players)
