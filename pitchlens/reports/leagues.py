"""How strong the leagues are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import avg_col
from pitchlens.functions.scalars import number_of_text
from pitchlens.reports.common import sides


def team_ids(match: DataFrame) -> DataFrame:
    """Distinct teams per tournament and season; ids that are no number drop out."""
    teams = sides(match, "tournament", "saison").withColumn(
        "teamid", number_of_text(F.col("teamid").cast("string"))
    )
    return teams.filter(F.col("teamid").isNotNull()).select(
        "tournament", "saison", "teamid"
    ).distinct()


def league_strength(match: DataFrame, results: DataFrame, teams: int = 5, x: int = 1) -> DataFrame:
    """Mean score of the best teams of each tournament and season.

    The rank filter works before the shuffle too: each task passes on only its best teams.
    """
    score = avg_col("off", x)
    per_team = results.groupBy("saison", "teamid").agg(F.avg(score).alias("mean"))
    league = ["tournament", "saison"]
    best_first = W.partitionBy(*league).orderBy(F.desc("mean"), "teamid")
    return (
        team_ids(match)
        .dropna(subset=league)
        .join(per_team, ["saison", "teamid"])
        .withColumn("_rank", F.row_number().over(best_first))
        .filter(F.col("_rank") <= teams)
        .groupBy(*league)
        .agg(F.avg("mean").alias("mean"))
    )
