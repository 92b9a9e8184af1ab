"""Curves over a player's career, and players compared with their team."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import avg_col, total_col
from pitchlens.operators.rolling import MATCH_ORDER, group_total, running_sum
from pitchlens.reports.common import top
from pitchlens.skew import HotKeys, by_key_size, split_join

MIN_AGE = 17
DAY = "target_match_timestamp"


def career_curve(
    scores: DataFrame,
    profile: DataFrame,
    names: Sequence[str],
    metric: str = total_col("diff", 1),
    min_age: float = MIN_AGE,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Running total of a score by age, for the players of the given names.

    Names are not unique, so every player of a name has a curve of their own.
    """
    chosen = profile.filter(F.col("playername").isin(list(names))).select("playerid", "playername")
    rows = split_join(
        scores.filter(F.col("age") >= min_age).select(
            "playerid", *MATCH_ORDER, DAY, "age", metric
        ),
        chosen,
        ["playerid"],
        hot=hot,
        spread_by=["matchid"],
    )
    curve = running_sum(rows, ["playerid"], DAY, MATCH_ORDER, {"score": metric}, hot=hot)
    return curve.select("playerid", "playername", "matchid", "teamid", "age", "score")


def team_minus_player(
    scores: DataFrame,
    profile: DataFrame,
    x: int = 1,
    min_age: float = MIN_AGE,
    hot_matches: HotKeys | None = None,
    hot_players: HotKeys | None = None,
) -> DataFrame:
    """The team's mean score of a match minus the player's, its sign, and the player's total.

    A sign of +1 says that the team did better than the player. The scores are read once: a team's players
    meet by a window, those of hot matches by a join.
    """
    total, avg = total_col("diff", x), avg_col("diff", x)
    grown = scores.filter(F.col("age") >= min_age).select(
        "matchid", "playerid", "teamid", "age", DAY, total, avg
    )
    known = profile.select("playerid")
    rows = split_join(grown, known, ["playerid"], hot=hot_players, spread_by=["matchid"])
    team = ["matchid", "teamid"]
    means = {f"team_{total}": F.avg(total), f"team_{avg}": F.avg(avg)}

    def usual(part: DataFrame) -> DataFrame:
        return part.withColumns({c: mean.over(W.partitionBy(*team)) for c, mean in means.items()})

    def heavy(part: DataFrame) -> DataFrame:
        per_team = part.groupBy(*team).agg(*[mean.alias(c) for c, mean in means.items()])
        joined = split_join(part, per_team, team, hot=hot_matches, spread_by=["playerid"])
        return joined.select(*part.columns, *means)

    compared = by_key_size(rows.dropna(subset=team), ["matchid"], usual, heavy, hot=hot_matches)
    difference = F.col(f"team_{total}") - F.col(total)
    compared = (
        compared.withColumn(f"diff_{total}", difference)
        .withColumn(f"diff_{avg}", F.col(f"team_{avg}") - F.col(avg))
        .withColumn(
            "diff_performance", F.coalesce(F.signum(difference).cast("int"), F.lit(0))
        )
    )
    return group_total(
        compared,
        ["playerid"],
        {"diff_performance_sum": "diff_performance"},
        hot=hot_players,
        spread_by=["matchid"],
    )


def team_minus_player_top(compared: DataFrame, n: int = 10) -> DataFrame:
    """The players whose team did better than they most often."""
    sums = compared.groupBy("playerid").agg(
        F.sum("diff_performance").alias("diff_performance_sum")
    )
    return top(sums, n, F.desc("diff_performance_sum"), "playerid")


def team_minus_player_curve(
    compared: DataFrame, profile: DataFrame, n: int = 10, hot: HotKeys | None = None
) -> DataFrame:
    """Running total of the sign by age, for the players of ``team_minus_player_top``."""
    leaders = team_minus_player_top(compared, n).join(
        profile.select("playerid", "playername"), "playerid"
    )
    rows = compared.select("playerid", *MATCH_ORDER, DAY, "age", "diff_performance").join(
        F.broadcast(leaders.select("playerid", "playername")), "playerid"
    )
    curve = running_sum(
        rows, ["playerid"], DAY, MATCH_ORDER, {"score": "diff_performance"}, hot=hot
    )
    return curve.select("playerid", "playername", "matchid", "teamid", "age", "score")
