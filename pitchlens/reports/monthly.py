"""Scores by calendar month: players, the average player, best and worst, running totals.

All take ``results``, the neutral and ranked rolling columns, at least of the seasons in question. Rows are combined
per player and month before anything else happens; what follows is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import NEUTRAL, RANKED, avg_col, playtime_col, total_col
from pitchlens.functions.scalars import month_of, year_of
from pitchlens.reports.common import top
from pitchlens.staging import small_or_plain, stage

DAY = "target_match_timestamp"
AVERAGE = "avg"
FLOOR_MINUTES = 800

# The metrics of a month, by side of the pitch.
OFFENSIVE = ["total_off", "avg_off", "total_ranked_off", "avg_ranked_off"]
DEFENSIVE = ["total_def", "avg_def", "total_ranked_def", "avg_ranked_def"]
METRICS = OFFENSIVE + DEFENSIVE
RANKED_METRICS = [m for m in METRICS if "ranked" in m]


def in_season(
    results: DataFrame, seasons: Sequence[str], tournaments: Sequence[str] | None = None
) -> DataFrame:
    rows = results.filter(F.col("saison").isin(list(seasons)))
    if tournaments is not None:
        rows = rows.filter(F.col("tournament").isin(list(tournaments)))
    return rows


def monthly_player(rows: DataFrame, x: int = 1, keys: Sequence[str] = ("playerid",)) -> DataFrame:
    """Per player and month: sums of the totals, means of the averages, playtime."""
    aggregates = []
    for family in (NEUTRAL, RANKED):
        for name in (family.off, family.deff):
            aggregates.append(F.sum(total_col(name, x)).alias(f"total_{name}"))
            aggregates.append(F.avg(avg_col(name, x)).alias(f"avg_{name}"))
    return rows.groupBy(*keys, month_of(DAY).alias("time")).agg(
        *aggregates, F.sum(playtime_col(x)).alias("playtime")
    )


def _month_list(rows: DataFrame) -> DataFrame:
    """One row with ``months``, the array of all months of the years that occur.

    ``rows`` may be the results or their months: both have the same years.
    """
    day = "time" if "time" in rows.columns else DAY
    first = F.make_date(F.min(F.year(day)), F.lit(1), F.lit(1))
    last = F.make_date(F.max(F.year(day)), F.lit(12), F.lit(1))
    months = F.sequence(first, last, F.make_interval(months=F.lit(1)))
    return rows.agg(months.alias("months"))


def month_spine(rows: DataFrame) -> DataFrame:
    return _month_list(rows).select(F.explode("months").alias("time"))


def _on_spine(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row of ``df`` once per month of the spine."""
    return df.withColumn("time", F.explode(_month_list(rows).scalar()))


def monthly_average_player(
    monthly: DataFrame, rows: DataFrame, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean over players per month, with 0 for months without any."""
    means = monthly.groupBy("time").agg(*[F.avg(m).alias(m) for m in metrics])
    spine = month_spine(rows)
    return (
        spine.join(means, "time", "left").na.fill(0.0).withColumn("name", F.lit(AVERAGE))
    )


def season_performance(monthly: DataFrame, floor: float = FLOOR_MINUTES) -> DataFrame:
    """Mean of each player's months, for players with at least ``floor`` minutes."""
    return (
        monthly.groupBy("playerid")
        .agg(
            *[F.avg(m).alias(m) for m in RANKED_METRICS],
            F.sum("playtime").alias("playtime"),
        )
        .filter(F.col("playtime") >= floor)
    )


def best(performance: DataFrame, metric: str, n: int = 5) -> DataFrame:
    return top(performance, n, F.desc(metric), "playerid")


def worst(performance: DataFrame, metric: str, n: int = 5) -> DataFrame:
    return top(performance, n, F.asc(metric), "playerid")


def _series(
    monthly: DataFrame, rows: DataFrame, chosen: DataFrame, points: Sequence[Column], names
) -> DataFrame:
    """The chosen players' months, 0 where they did not play."""
    keys = ["playerid", "time"]
    spread = _on_spine(chosen.select("playerid", F.col("name")), rows)
    dense = spread.join(monthly.select(*keys, *points), keys, "left").na.fill(0.0, list(names))
    return dense.select("time", "name", *names)


def best_series(
    monthly: DataFrame, rows: DataFrame, metric: str, n: int = 5, floor: float = FLOOR_MINUTES
) -> DataFrame:
    """The best players' months beside the average player's: time, name, points."""
    leaders = best(season_performance(monthly, floor), metric, n)
    leaders = leaders.withColumn("name", F.col("playerid").cast("string"))
    players = _series(monthly, rows, leaders, [F.col(metric).alias("points")], ["points"])
    average = monthly_average_player(monthly, rows, [metric])
    return players.unionByName(average.select("time", "name", F.col(metric).alias("points")))


def shifted_series(
    monthly: DataFrame, rows: DataFrame, metric: str, n: int = 5, floor: float = FLOOR_MINUTES
) -> DataFrame:
    """``best_series`` with the metric measured from the lowest player's, so that it starts at 0.

    Months that were filled in stay 0.
    """
    performance = season_performance(monthly, floor)
    lowest = performance.agg(F.min(metric)).scalar()
    leaders = best(performance, metric, n)
    leaders = leaders.withColumn("name", F.col("playerid").cast("string"))
    points = (F.col(metric) - lowest).alias("points")
    players = _series(monthly, rows, leaders, [points], ["points"])
    means = monthly.groupBy("time").agg(F.avg(metric).alias(metric)).select("time", points)
    average = (
        month_spine(rows)
        .join(means, "time", "left")
        .na.fill(0.0)
        .select("time", F.lit(AVERAGE).alias("name"), "points")
    )
    return players.unionByName(average)


def relevant_tournaments(
    results: DataFrame, players: Sequence[int], seasons: Sequence[str]
) -> DataFrame:
    """Tournaments the players took part in."""
    return (
        in_season(results, seasons)
        .filter(F.col("playerid").isin(list(players)))
        .select("tournament")
        .distinct()
    )


def chosen_player_series(
    results: DataFrame, names: dict[int, str], seasons: Sequence[str], x: int = 1
) -> DataFrame:
    """Offensive months of chosen players beside the average player of their tournaments."""
    wanted = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    season = in_season(results, seasons)
    chosen = season.filter(F.col("playerid").isin(list(names)))
    own = chosen.withColumn("name", wanted[F.col("playerid")])
    listed = results.sparkSession.createDataFrame(
        list(names.items()), "playerid bigint, name string"
    )
    monthly = monthly_player(own, x, ["playerid"])
    points = [F.col(m) for m in OFFENSIVE]
    players = _series(monthly, chosen, listed, points, OFFENSIVE)
    tournaments = relevant_tournaments(results, list(names), seasons)
    # There are few tournaments, each with very many rows: these stay where they are.
    tournaments = small_or_plain(tournaments, "tournaments")
    peers = season.join(tournaments, "tournament", "left_semi")
    average = monthly_average_player(monthly_player(peers, x), chosen, OFFENSIVE)
    return players.unionByName(average.select("time", "name", *OFFENSIVE))


def running_total(
    results: DataFrame, players: Sequence[int], x: int = 1, compat: bool = False
) -> DataFrame:
    """Running totals of ranked points by day.

    Days are combined first, so a player's window holds one row per day. With ``compat`` a day
    with several matches counts everything up to it once per match.
    """
    off, deff = total_col(RANKED.off, x), total_col(RANKED.deff, x)
    days = (
        results.filter(F.col("playerid").isin(list(players)))
        .groupBy("playerid", DAY)
        .agg(F.sum(off).alias(off), F.sum(deff).alias(deff), F.count(F.lit(1)).alias("_n"))
    )
    until = W.partitionBy("playerid").orderBy(DAY)
    until = until.rowsBetween(W.unboundedPreceding, W.currentRow)
    times = F.col("_n") if compat else F.lit(1)
    return days.select(
        "playerid", DAY, *[(F.sum(c).over(until) * times).alias(c) for c in (off, deff)]
    )


def running_total_yearly(totals: DataFrame, x: int = 1) -> DataFrame:
    """Per year the highest offensive and the lowest defensive running total."""
    off, deff = total_col(RANKED.off, x), total_col(RANKED.deff, x)
    return totals.groupBy("playerid", year_of(DAY).alias("time")).agg(
        F.max(off).alias(off), F.min(deff).alias(deff)
    )


def filtered_count(results: DataFrame, player: int, season: str) -> DataFrame:
    """Rows of one player in one season."""
    rows = results.filter((F.col("playerid") == player) & (F.col("saison") == season))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def topn_cumulative(
    results: DataFrame,
    profile: DataFrame,
    metric: str,
    target_seasons: Sequence[str],
    player_seasons: Sequence[str],
    player_tournaments: Sequence[str],
    floor: float = 2000,
    n: int = 10,
    x: int = 1,
) -> DataFrame:
    """Running total by month for the ``n`` best players of a metric.

    Players count who appeared in ``player_seasons`` and ``player_tournaments`` and have more
    than ``floor`` minutes per target season but one. ``place`` is the player's rank; every
    month in which any of them played has a row for each.
    """
    monthly = monthly_player(in_season(results, target_seasons), x)
    for side in ("total_diff", "avg_diff"):
        monthly = monthly.withColumn(side, F.col(f"{side[:-5]}_off") + F.col(f"{side[:-5]}_def"))
    members = in_season(results, player_seasons, player_tournaments).select("playerid").distinct()
    known = profile.select("playerid", "playername")
    # Small next to the results, and several steps below read it.
    monthly = monthly.select("playerid", "time", "playtime", metric)
    monthly = stage(
        monthly.join(members, "playerid", "left_semi").join(known, "playerid"), "months"
    )
    value = F.avg(metric) if metric.startswith("avg") else F.sum(metric)
    overall = (
        monthly.groupBy("playerid")
        .agg(value.alias("overall"), F.sum("playtime").alias("playtime"))
        .filter(F.col("playtime") > floor * (len(target_seasons) - 1))
    )
    leaders = top(overall, n, F.desc("overall"), "playerid")
    # At most n rows from here on.
    place = F.row_number().over(W.orderBy(F.desc("overall"), "playerid"))
    leaders = leaders.select("playerid", place.alias("place"))
    rows = monthly.join(F.broadcast(leaders), "playerid").select(
        "playerid", "playername", "place", "time", metric
    )
    months = rows.agg(F.collect_set("time").alias("months")).scalar()
    dense = (
        rows.select("playerid", "playername", "place")
        .distinct()
        .withColumn("time", F.explode(months))
        .join(rows.select("playerid", "time", metric), ["playerid", "time"], "left")
    )
    until = W.partitionBy("playerid").orderBy("time")
    until = until.rowsBetween(W.unboundedPreceding, W.currentRow)
    return dense.select(
        "place",
        "playerid",
        "playername",
        "time",
        F.sum(F.coalesce(F.col(metric), F.lit(0))).over(until).cast("double").alias("points"),
    )


def topn_pivot(cumulative: DataFrame, n: int = 10) -> DataFrame:
    """``topn_cumulative`` with one column per place. The places are known beforehand, so no
    query runs to find the columns."""
    return (
        cumulative.groupBy("time")
        .pivot("place", list(range(1, n + 1)))
        .agg(F.first("points"))
        .withColumnsRenamed({str(i): f"place_{i}" for i in range(1, n + 1)})
    )
