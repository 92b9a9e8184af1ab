"""The graph of players who were in a match for the same team."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.skew import HotKeys, split_join
from pitchlens.staging import stage


def coplay_presence(
    player_time: DataFrame,
    match: DataFrame,
    since: datetime.date,
    countries: Sequence[str],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Players and teams of the chosen matches, one row each, with the day of the match."""
    chosen = match.filter(
        (F.col("matchday") >= F.lit(since)) & F.col("country").isin(list(countries))
    ).select("matchid", "matchday")
    present = player_time.filter(F.col("playerid").isNotNull())
    present = present.select("playerid", "matchid", "teamid")
    return split_join(present, chosen, ["matchid"], hot=hot, spread_by=["playerid", "teamid"])


def coplay_nodes(present: DataFrame, profile: DataFrame, team: DataFrame) -> DataFrame:
    """Each player with the team of their last match; one row per team if there were several."""
    newest = W.partitionBy("playerid").orderBy(F.desc("matchday"))
    last = (
        present.withColumn("_rank", F.rank().over(newest))
        .filter("_rank = 1")
        .select("playerid", "teamid")
        .join(team, "teamid")
        .select("playerid", "teamname")
    )
    return profile.join(last, "playerid").select(
        F.col("playerid").alias("id"),
        F.col("playername").alias("label"),
        "nationality",
        "position",
        "teamname",
    )


def _pairs(
    present: DataFrame,
    nodes: DataFrame,
    hot_matches: HotKeys | None,
    hot_players: HotKeys | None,
    both_ways: bool,
    distinct: bool = True,
) -> DataFrame:
    """Pairs of players with an entry for the same match and team.

    The edge list itself has one row per pair, so its size is set by the squads. Players that
    are no nodes are dropped before the join, and each piece of a large match meets the squad
    separately.
    """
    ids = nodes.select(F.col("id").alias("playerid"))
    if distinct:
        ids = ids.distinct()
    squad = present.select("playerid", "matchid", "teamid")
    # Both sides of the self-join read it, so it is stored once.
    squad = stage(
        split_join(squad, ids, ["playerid"], hot=hot_players, spread_by=["matchid"]), "squad"
    )
    others = squad.withColumnRenamed("playerid", "target")
    pairs = split_join(
        squad.withColumnRenamed("playerid", "source"),
        others,
        ["matchid", "teamid"],
        hot=hot_matches,
        spread_by=["source"],
    )
    keep = F.col("source") != F.col("target") if both_ways else F.col("source") < F.col("target")
    return pairs.filter(keep)


def coplay_edges(
    present: DataFrame,
    nodes: DataFrame,
    hot_matches: HotKeys | None = None,
    hot_players: HotKeys | None = None,
    compat: bool = False,
) -> DataFrame:
    """One edge per match, team and ordered pair of players, where both ends are nodes.

    With ``compat`` a player who is listed with several last teams has as many copies of each edge.
    """
    pairs = _pairs(present, nodes, hot_matches, hot_players, both_ways=True, distinct=not compat)
    return pairs.select("source", "target")


def coplay_edges_weighted(
    present: DataFrame,
    nodes: DataFrame,
    hot_matches: HotKeys | None = None,
    hot_players: HotKeys | None = None,
) -> DataFrame:
    """Edges with the number of times two players came together.

    Each pair is formed in one direction and counted before the shuffle; the counts are then
    mirrored, so the result is the grouped form of ``coplay_edges`` at half its work.
    """
    counted = (
        _pairs(present, nodes, hot_matches, hot_players, both_ways=False)
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    mirrored = F.array(
        F.struct("source", "target"),
        F.struct(F.col("target").alias("source"), F.col("source").alias("target")),
    )
    return counted.select(F.inline(mirrored), "weight")
