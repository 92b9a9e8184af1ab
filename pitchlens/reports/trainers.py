"""What difference a trainer makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.functions import scalars
from pitchlens.skew import HotKeys, split_join


def match_points(
    match: DataFrame, goal: DataFrame, since: int, until: int, compat: bool = False
) -> DataFrame:
    """Points of each team in each match, for seasons from ``since`` to before ``until``.

    A side without goals counts as 0; with ``compat`` matches in which a side did not score
    are left out. Goals are counted per side of a match in one pass, so both sides of a match
    come from a single join.
    """
    season = F.col("saison").try_cast("int")
    chosen = match.filter((season >= since) & (season < until)).select(
        "matchid", season.alias("saison"), "tournament", "country", "refereeid",
        "hometeam", "guestteam",
    )
    scored = (
        goal.dropna(subset=["matchid", "teamid"])
        .groupBy("matchid", "teamid")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("matchid")
        .agg(F.map_from_entries(F.collect_list(F.struct("teamid", "n"))).alias("scored"))
    )
    joined = chosen.join(scored, "matchid", "inner" if compat else "left")
    joined = joined.withColumn("home", F.try_element_at("scored", F.col("hometeam"))).withColumn(
        "guest", F.try_element_at("scored", F.col("guestteam"))
    )
    if compat:
        joined = joined.filter(F.col("home").isNotNull() & F.col("guest").isNotNull())
    joined = joined.na.fill(0, ["home", "guest"])

    def side(team: str, own: str, other: str):
        return F.struct(
            F.col(team).alias("teamid"), scalars.match_points(own, other).alias("score")
        )

    both = F.array(side("hometeam", "home", "guest"), side("guestteam", "guest", "home"))
    return joined.select(
        "matchid", "saison", "tournament", "country", "refereeid", F.inline(both)
    )


def trainer_effect(
    points: DataFrame,
    trainer: DataFrame,
    trainer_name: DataFrame,
    tournament: str,
    since: int,
    compat: bool = False,
    hot_teams: HotKeys | None = None,
) -> DataFrame:
    """A trainer's mean points with a team compared with the team's mean over all seasons.

    Teams count that played in ``tournament`` since season ``since``, and trainers that were
    with one of them in those matches; with ``compat`` also trainers of their opponents.
    Scores are combined per trainer and team before names are looked up.
    """
    trainer = trainer.dropDuplicates().select(
        "trainer", F.col("team").alias("teamid"), F.col("match").alias("matchid")
    )
    names = trainer_name.dropDuplicates()
    recent = points.filter((F.col("saison") >= since) & (F.col("tournament") == tournament))
    teams = recent.select("teamid").distinct()
    relevant = split_join(
        points.filter(F.col("saison") >= since),
        teams,
        ["teamid"],
        hot=hot_teams,
        spread_by=["matchid"],
    )
    per_trainer = (
        relevant.join(trainer, ["teamid", "matchid"])
        .groupBy("trainer", "teamid")
        .agg(F.avg("score").alias("trainer_mean"), F.count("score").alias("trainer_match_count"))
        .join(names, "trainer")
    )
    per_team = points.groupBy("teamid").agg(
        F.avg("score").alias("team_mean"), F.count("score").alias("team_match_count")
    )
    compared = per_team.join(per_trainer, "teamid").withColumn(
        "trainer_team_diff", F.col("trainer_mean") - F.col("team_mean")
    )
    summed = compared.groupBy("trainer", "trainername", "teamid", "team_mean").agg(
        F.avg("trainer_team_diff").alias("trainer_team_diffs"),
        F.sum("trainer_match_count").alias("trainer_match_counts"),
    )
    on = ["matchid"] if compat else ["matchid", "teamid"]
    listed = recent.select(*on).distinct().join(trainer.select("trainer", *on), on)
    listed = listed.select("trainer").distinct()
    return summed.join(listed, "trainer", "left_semi").orderBy(
        F.desc("trainer_team_diffs"), "trainer", "teamid"
    )
