"""First look at a data set: counts, referees and their cards, playtimes and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.scalars import position_kind
from pitchlens.reports.common import sides, top


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def matches_by_season(match: DataFrame) -> DataFrame:
    return match.dropna(subset=["saison"]).groupBy("saison").agg(_count("matches"))


def top_countries(match: DataFrame, n: int = 30) -> DataFrame:
    counts = match.dropna(subset=["country"]).groupBy("country").agg(_count("matches"))
    return top(counts, n, F.desc("matches"), "country")


def top_tournaments(match: DataFrame, n: int = 30) -> DataFrame:
    keys = ["tournament", "country"]
    counts = match.dropna(subset=keys).groupBy(*keys).agg(_count("matches"))
    return top(counts, n, F.desc("matches"), *keys)


def top_referees(match: DataFrame, referee: DataFrame, n: int = 20) -> DataFrame:
    """Matches are counted per referee first, so the join meets one row per referee."""
    counts = match.dropna(subset=["refereeid"]).groupBy("refereeid").agg(_count("matches"))
    return top(counts.join(referee, "refereeid"), n, F.desc("matches"), "refereeid")


def top_teams(match: DataFrame, team: DataFrame, n: int = 20) -> DataFrame:
    counts = (
        sides(match).dropna(subset=["teamid"]).groupBy("teamid").agg(_count("matches"))
    )
    return top(counts.join(team, "teamid"), n, F.desc("matches"), "teamid")


def referee_card_diff(
    match: DataFrame,
    card: DataFrame,
    tournament: str,
    seasons: Sequence[str],
    min_matches: int = 2,
) -> DataFrame:
    """Cards a team gets under a referee compared with its average over all referees.

    Means are taken match by match, then referee by referee; matches without any card do not
    count in them. Kept are pairs that met in more than ``min_matches`` matches.
    """
    chosen = match.filter(
        (F.col("tournament") == tournament) & F.col("saison").isin(list(seasons))
    )
    played = sides(chosen.dropna(subset=["refereeid"]), "refereeid").drop("is_home", "opponent")
    cards = card.groupBy("matchid", "teamid").agg(_count("cards"))
    # One pass for both: a match without cards counts as a match, but not in the mean.
    by_referee = (
        played.join(cards, ["matchid", "teamid"], "left")
        .groupBy("refereeid", "teamid")
        .agg(F.avg("cards").alias("avg_referee"), _count("match_count"))
        .filter(F.col("avg_referee").isNotNull())
    )
    by_team = by_referee.groupBy("teamid").agg(F.avg("avg_referee").alias("avg_team"))
    return (
        by_referee.join(by_team, "teamid")
        .filter(F.col("match_count") > min_matches)
        .withColumn("diff", F.col("avg_referee") - F.col("avg_team"))
        .select("refereeid", "teamid", "avg_team", "avg_referee", "match_count", "diff")
    )


def _extreme_teams(diffs: DataFrame, team: DataFrame, referee: DataFrame, order) -> DataFrame:
    """Per referee the team that comes first in ``order``, ties kept.

    The rank filter works before the shuffle too, so no task collects a referee's teams.
    """
    first = W.partitionBy("refereeid").orderBy(order)
    return (
        diffs.withColumn("_rank", F.rank().over(first))
        .filter("_rank = 1")
        .select("refereeid", "teamid", "diff", "match_count")
        .join(team, "teamid")
        .join(referee, "refereeid")
        .orderBy(order, "refereeid", "teamid")
    )


def referee_most_cards(diffs: DataFrame, team: DataFrame, referee: DataFrame) -> DataFrame:
    return _extreme_teams(diffs, team, referee, F.desc("diff"))


def referee_least_cards(diffs: DataFrame, team: DataFrame, referee: DataFrame) -> DataFrame:
    return _extreme_teams(diffs, team, referee, F.asc("diff"))


def referee_fav_hate(diffs: DataFrame, team: DataFrame, referee: DataFrame) -> DataFrame:
    """Each referee's favourite team (fewest cards) beside the one they book most."""
    keys = ["refereeid", "refereename"]
    liked = referee_least_cards(diffs, team, referee).select(
        *keys, F.col("teamname").alias("favourite_team")
    )
    disliked = referee_most_cards(diffs, team, referee).select(
        *keys, F.col("teamname").alias("hate_team")
    )
    return (
        liked.join(disliked, keys)
        .filter(F.col("favourite_team") != F.col("hate_team"))
        .select(F.col("refereename").alias("referee"), "favourite_team", "hate_team")
    )


def played_since(played: DataFrame, since: int) -> DataFrame:
    """Player times of seasons from ``since`` on; seasons that are no number drop out."""
    return played.filter(F.col("saison").try_cast("int") >= since)


def top_playtime(played: DataFrame) -> DataFrame:
    """The player with most playtime per tournament and season, ties kept."""
    keys = ["tournament", "saison"]
    sums = (
        played.dropna(subset=[*keys, "playerid"])
        .groupBy(*keys, "playerid")
        .agg(F.sum("playtime").alias("playtime_max"))
    )
    most = W.partitionBy(*keys).orderBy(F.desc("playtime_max"))
    return sums.withColumn("_rank", F.rank().over(most)).filter("_rank = 1").drop("_rank")


def position_counts(leaders: DataFrame, profile: DataFrame) -> DataFrame:
    """How often each position comes up among ``leaders`` (see ``top_playtime``)."""
    return (
        leaders.join(profile.select("playerid", "position"), "playerid")
        .dropna(subset=["position"])
        .groupBy("position")
        .agg(_count("players"))
    )


def position_kind_counts(leaders: DataFrame, profile: DataFrame) -> DataFrame:
    kinds = profile.select("playerid", position_kind("position").alias("position_kind"))
    return (
        leaders.join(kinds, "playerid")
        .dropna(subset=["position_kind"])
        .groupBy("position_kind")
        .agg(_count("players"))
    )


def _mean_playtime(played: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    per_player = (
        played.dropna(subset=["playerid"])
        .groupBy("playerid")
        .agg(F.avg("playtime").alias("playtime"))
    )
    return (
        per_player.join(labels, "playerid")
        .dropna(subset=[label])
        .groupBy(label)
        .agg(F.avg("playtime").alias("playtime"))
        .orderBy(F.desc("playtime"), label)
    )


def playtime_by_position(played: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean over players of their mean playtime."""
    return _mean_playtime(played, profile.select("playerid", "position"), "position")


def playtime_by_kind(played: DataFrame, profile: DataFrame) -> DataFrame:
    kinds = profile.select("playerid", position_kind("position").alias("position_kind"))
    return _mean_playtime(played, kinds, "position_kind")
