"""Neutral points: what happened on the scoreboard while a player was on the pitch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.operators.pitch_time import ENTRY, presence
from pitchlens.schema import Tables
from pitchlens.skew import dealt_by

# Points for a goal of the own side, and for one conceded.
GOAL_FOR = 1.0
GOAL_AGAINST = -1


def goal_minutes(tables: Tables) -> DataFrame:
    """One row per match, team and minute with goals: their number ``n``, and ``n_unnamed`` without a scorer.

    They are dealt out by match, where they are needed, in the same shuffle (unless they are stored so).
    """
    goal = tables.goal.filter(F.col("time").isNotNull() & F.col("teamid").isNotNull())
    if tables.stored_entries is None:
        goal = dealt_by(goal, "matchid", tables.hot_matches)
    return goal.groupBy("matchid", "teamid", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("scorer").isNull(), 1)).alias("n_unnamed"),
    )


def goals_per_match(tables: Tables) -> DataFrame:
    """One row per match with ``goals``: team, minute, number of goals, and of those without a
    scorer.

    Goals are counted per team and minute first, so the array is bounded by the minutes of a
    match and a match with any number of goal rows stays small.
    """
    return (
        goal_minutes(tables)
        .groupBy("matchid")
        .agg(F.collect_list(F.struct("teamid", "time", "n", "n_unnamed")).alias("goals"))
    )


def match_facts(tables: Tables) -> DataFrame:
    """Every match with its goals; both sides have one row per match."""
    return tables.match.join(goals_per_match(tables), "matchid", "left")


def _goals_on_pitch(own: bool) -> Column:
    """Goals of the own side (or of any other) that fall into a spell, over all spells."""
    side = "g.teamid = teamid" if own else "g.teamid <> teamid"
    return F.coalesce(
        F.expr(
            f"""
            aggregate(spells, 0L, (total, s) -> total + aggregate(
                filter(goals, g -> {side} and g.time between s.in_time and s.out_time),
                0L, (inner_total, g) -> inner_total + g.n))
            """
        ),
        F.lit(0).cast("bigint"),
    )


def with_neutral_points(present: DataFrame) -> DataFrame:
    """Add playtime, off, def and diff to rows that carry ``spells`` and ``goals``."""
    minutes = F.expr("aggregate(spells, 0L, (total, s) -> total + s.playtime)")
    return (
        present.withColumn("playtime", minutes)
        .withColumn("off", _goals_on_pitch(own=True) * F.lit(GOAL_FOR))
        .withColumn("def", _goals_on_pitch(own=False) * F.lit(GOAL_AGAINST).cast("bigint"))
        .withColumn("diff", F.col("off") + F.col("def"))
    )


def match_presence(tables: Tables) -> DataFrame:
    """One row per known player, match and team: spells, goals of the match, and neutral points.

    Starters without an id have times on the pitch, but no points: they are not one player.
    """
    known = presence(tables, match_facts(tables)).filter(F.col("playerid").isNotNull())
    return with_neutral_points(known)


def neutral_off_points(tables: Tables) -> DataFrame:
    return (
        match_presence(tables)
        .groupBy("matchid", "playerid")
        .agg(F.sum("off").alias("off_points"))
    )


def neutral_def_points(tables: Tables, compat: bool = False) -> DataFrame:
    """Points for goals conceded while on the pitch.

    With ``compat``, players who conceded nothing have no row for their match; instead every
    player has a zero row whose match id is their team id.
    """
    present = match_presence(tables)
    points = present.groupBy("matchid", "playerid").agg(F.sum("def").alias("def_points"))
    if not compat:
        return points
    zeros = present.select(
        F.col("teamid").alias("matchid"), "playerid", F.lit(0).cast("bigint").alias("def_points")
    )
    return (
        points.filter(F.col("def_points") < 0)
        .unionByName(zeros)
        .groupBy("matchid", "playerid")
        .agg(F.sum("def_points").alias("def_points"))
    )


def neutral_points(tables: Tables) -> DataFrame:
    """Points per player, match and team, with the columns of the match that reports need."""
    return match_presence(tables).select(
        *ENTRY, "matchday", "saison", "tournament", "playtime", "off", "def", "diff"
    )


def neutral_points_compat(tables: Tables) -> DataFrame:
    """As ``neutral_points``, without the players that ``neutral_def_points(compat=True)`` lacks."""
    points = neutral_points(tables).drop("def", "diff")
    conceded = neutral_def_points(tables, compat=True).withColumnRenamed("def_points", "def")
    return points.join(conceded, ["playerid", "matchid"]).withColumn(
        "diff", F.col("off") + F.col("def")
    )
