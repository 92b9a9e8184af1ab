"""Training data for the goal model: one row per match and team."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import ATTRIBUTE_ORDER, averages_in
from pitchlens.functions.scalars import per_minute
from pitchlens.operators.rolling import as_of
from pitchlens.reports.common import sides
from pitchlens.skew import HotKeys, by_key_size, dealt_by, find_hot, split_join

DAY = "target_match_timestamp"
ATTRIBUTES = ATTRIBUTE_ORDER


def team_goal_table(match: DataFrame, goal: DataFrame) -> DataFrame:
    """Goals per match and team, 0 included. Goals of a team that is not the home team count
    for the guest side."""
    base = ["matchday", "saison", "matchlength"]
    scored = (
        goal.dropna(subset=["matchid", "teamid"])
        .groupBy("matchid", "teamid")
        .agg(F.count(F.lit(1)).alias("goals"))
        .join(match.select("matchid", *base, "hometeam", "guestteam"), "matchid")
        .withColumn("is_home", F.col("teamid") == F.col("hometeam"))
        .withColumn(
            "opponent", F.when(F.col("is_home"), F.col("guestteam")).otherwise(F.col("hometeam"))
        )
    )
    keys = ["matchid", *base, "teamid", "opponent", "is_home"]
    nothing = sides(match, *base).withColumn("goals", F.lit(0).cast("bigint"))
    return (
        scored.select(*keys, "goals")
        .unionByName(nothing.select(*keys, "goals"))
        .groupBy(*keys)
        .agg(F.max("goals").alias("goals"))
    )


def matches_by_year(match: DataFrame, since: int) -> DataFrame:
    year = F.year("matchday")
    return (
        match.filter(year >= since).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("matches"))
    )


def lineups_since(
    match: DataFrame, player: DataFrame, since: int, hot: HotKeys | None = None
) -> DataFrame:
    """Starting players of the matches from year ``since`` on, with the day of the match."""
    days = match.filter(F.year("matchday") >= since).select("matchid", "matchday")
    lineups = player.select("matchid", "teamid", "playerid")
    return split_join(lineups, days, ["matchid"], hot=hot, spread_by=["playerid", "teamid"])


def asof_scores(
    lineups: DataFrame,
    scores: DataFrame,
    attributes: Sequence[str] = ATTRIBUTES,
    compat: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Each starting player with their latest scores for the team before the day of the match.

    With ``compat`` the latest scores of any other match count, even of a later one.
    """
    keys = ["teamid", "playerid"]
    if not compat:
        return as_of(lineups, scores, keys, "matchday", DAY, attributes, hot=hot).select(
            "matchid", *keys, F.col("_as_of").alias("score_day"), *attributes
        )
    if hot is None:
        hot = find_hot(lineups.select(*keys).unionByName(scores.select(*keys)), keys)
    if hot.rows is None:
        scores = _two_latest_days(scores, keys)
    offered = scores.dropna(subset=keys).select(
        *keys, "matchid", F.col(DAY).alias("_day"), F.struct(*attributes).alias("_values"), F.lit(True).alias("_offered")
    )
    asking = lineups.select(*keys, "matchid", F.lit(False).alias("_offered"))
    rows = asking.unionByName(offered, allowMissingColumns=True)
    columns = ["matchid", *keys, "score_day", *attributes]

    def usual(part: DataFrame) -> DataFrame:
        return _latest_other(part, keys).select(*columns)

    def heavy(part: DataFrame) -> DataFrame:
        values = part.filter("_offered").select(*keys, "matchid", F.col("_day").alias(DAY), "_values.*")
        asked = part.filter(~F.col("_offered")).select(*keys, "matchid")
        return _latest_other_by_join(asked, values, keys, attributes, hot).select(*columns)

    return by_key_size(rows, list(hot.keys), usual, heavy, hot=hot)


def _two_latest_days(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``_latest_other`` can take. Where scores are dealt out by player, no others travel."""
    latest_first = W.partitionBy(*keys).orderBy(F.desc(DAY))
    return scores.withColumn("_rank", F.dense_rank().over(latest_first)).filter("_rank <= 2").drop("_rank")


def _latest_other(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Offered and asking rows of a key meet in one shuffle; windows carry the key's two latest days.

    Of these days the first with a match other than the asking one; all rows of that day are taken.
    Asking rows whose key has no scores stay, with NULLs, those with scores of their own match only go.
    """
    key = W.partitionBy(*keys)
    newest = F.col("_day") == F.col("_first")
    entry = F.struct(F.col("_day").alias("day"), F.col("_values").alias("v"))
    rows = rows.withColumns({"_first": F.max("_day").over(key), "_known": F.max("_offered").over(key)})
    rows = rows.withColumns(
        {
            "_second": F.max(F.when(F.col("_day") < F.col("_first"), F.col("_day"))).over(key),
            "_n": F.count(F.when(newest, 1)).over(key),
            "_in": F.max(F.when(newest, F.col("matchid"))).over(key),
        }
    )
    of_two = F.col("_day") >= F.coalesce("_second", "_first")
    rows = rows.withColumn("_entries", F.collect_list(F.when(of_two, entry)).over(key))
    is_other = (F.col("_n") > 1) | (F.col("_in") != F.col("matchid"))
    asked = rows.filter(~F.col("_offered")).withColumn(
        "score_day", F.when(is_other, F.col("_first")).otherwise(F.col("_second"))
    )
    asked = asked.filter(~F.col("_known") | F.col("score_day").isNotNull())
    found = F.filter("_entries", lambda e: e["day"] == F.col("score_day"))
    asked = asked.select("matchid", *keys, "score_day", F.explode_outer(found).alias("_found"))
    return asked.select("matchid", *keys, "score_day", "_found.v.*")


def _latest_other_by_join(
    lineups: DataFrame, scores: DataFrame, keys: list[str], attributes: Sequence[str], hot: HotKeys
) -> DataFrame:
    """The same for hot keys: days are counted first, and the answers joined back in parts."""
    days = scores.groupBy(*keys, DAY).agg(
        F.count(F.lit(1)).alias("n"), F.max("matchid").alias("scored_in")
    )
    latest_first = W.partitionBy(*keys).orderBy(F.desc(DAY))
    entry = F.struct("n", "scored_in", F.col(DAY).alias("score_day"))
    newest = (
        days.withColumn("_rank", F.row_number().over(latest_first))
        .filter(F.col("_rank") <= 2)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_rank") == 1, entry)).alias("first"),
            F.max(F.when(F.col("_rank") == 2, entry)).alias("second"),
        )
    )
    is_other = (F.col("first.n") > 1) | (F.col("first.scored_in") != F.col("matchid"))
    score_day = F.when(is_other, F.col("first.score_day")).otherwise(F.col("second.score_day"))
    dated = split_join(lineups, newest, keys, "left", hot=hot, spread_by=["matchid"])
    dated = dated.withColumn("score_day", score_day).filter(
        F.col("first").isNull() | F.col("score_day").isNotNull()
    )
    values = scores.select(*keys, F.col(DAY).alias("score_day"), *attributes)
    # Most of a player's matches ask for the same day, so this key is as hot as the player.
    return split_join(
        dated, values, [*keys, "score_day"], "left", hot=hot, spread_by=["matchid"]
    ).select("matchid", *keys, "score_day", *attributes)


def team_strength(
    known: DataFrame, player_time: DataFrame, attributes: Sequence[str] = ATTRIBUTES
) -> DataFrame:
    """Per match and team, the players' attributes weighted by their minutes in the match."""
    minutes = player_time.groupBy("matchid", "playerid").agg(F.sum("playtime").alias("playtime"))
    weighted = known.join(minutes, ["matchid", "playerid"], "left")
    return weighted.groupBy("matchid", "teamid").agg(
        F.sum("playtime").alias("playtime"),
        *[F.sum(F.col(a) * F.col("playtime")).alias(a) for a in attributes],
    )


def with_minutes(lineups: DataFrame, points: DataFrame) -> DataFrame:
    """Starting players with ``minutes``, what they played in the match for any team."""
    minutes = points.groupBy("matchid", "playerid").agg(F.sum("playtime").alias("minutes"))
    return lineups.join(minutes, ["matchid", "playerid"], "left")


def strength_as_of(
    lineups: DataFrame,
    scores: DataFrame,
    hot_matches: HotKeys,
    hot_players: HotKeys,
    attributes: Sequence[str] = ATTRIBUTES,
) -> DataFrame:
    """``team_strength`` of ``asof_scores``, for ``lineups`` that come with their minutes.

    Both sides are dealt out by player while they are narrow. The scores then go to their match once, without
    the averages, which follow from totals and playtimes there.
    """
    keys = ["teamid", "playerid"]
    averages = averages_in(attributes)
    carried = [a for a in attributes if a not in averages]
    asking = dealt_by(lineups, "playerid", hot_players)
    known = as_of(asking, scores, keys, "matchday", DAY, carried, hot=hot_players)
    known = dealt_by(known.select("matchid", "teamid", "minutes", *carried), "matchid", hot_matches)
    known = known.withColumns({a: per_minute(*both) for a, both in averages.items()})
    return known.groupBy("matchid", "teamid").agg(
        F.sum("minutes").alias("playtime"), *[F.sum(F.col(a) * F.col("minutes")).alias(a) for a in attributes]
    )


def _with_teams(goals: DataFrame, strength: DataFrame) -> DataFrame:
    """Goals with ``_own`` and ``_other``, the strength of both teams; rows that lack one are dropped.

    The teams of a match come together in one row first, so goals are joined once.
    """
    columns = [c for c in strength.columns if c != "matchid"]
    teams = strength.groupBy("matchid").agg(F.collect_list(F.struct(*columns)).alias("_teams"))

    def of(side: str) -> Column:
        return F.get(F.filter("_teams", lambda t: t["teamid"] == F.col(side)), F.lit(0))

    found = goals.join(teams, "matchid").withColumns({"_own": of("teamid"), "_other": of("opponent")})
    return found.filter(F.col("_own").isNotNull() & F.col("_other").isNotNull())


def match_features(goals: DataFrame, strength: DataFrame) -> DataFrame:
    """Goals of a team with its own and its opponent's strength, and the parts of the date."""
    columns = [c for c in strength.columns if c not in ("matchid", "teamid")]
    keys = ["matchid", "opponent", "teamid"]
    return _with_teams(goals, strength).select(
        *keys,
        *[c for c in goals.columns if c not in keys],
        *[F.col(f"_own.{c}").alias(c) for c in columns],
        *[F.col(f"_other.{c}").alias(f"opponent_{c}") for c in columns],
        F.year("matchday").alias("year"),
        F.month("matchday").alias("month"),
        F.dayofmonth("matchday").alias("day"),
    )


def match_features_norm(
    features: DataFrame, attributes: Sequence[str] = ATTRIBUTES, keep_ids: bool = False
) -> DataFrame:
    """Rows without NULLs, attributes per minute of the match, ids removed (unless kept)."""
    named = [*attributes, *[f"opponent_{a}" for a in attributes]]
    scaled = {a: per_minute(a, "matchlength") for a in named}
    complete = features.na.drop().withColumns(scaled)
    return complete if keep_ids else complete.drop("matchday", "teamid", "opponent", "matchid")


# Any number of attributes, as one array per row. Which attribute stands where is a list of names that
# goes along; plans do not grow with it.

VECTOR = "attributes"


def as_vector(scores: DataFrame, attributes: Sequence[str], day: str = DAY) -> DataFrame:
    """Ids and day of each score row, and the attributes as an array of doubles."""
    values = F.array(*[F.col(a).cast("double") for a in attributes])
    return scores.select("playerid", "matchid", "teamid", day, values.alias(VECTOR))


def vectors_as_of(
    lineups: DataFrame,
    scores: DataFrame,
    hot_matches: HotKeys,
    hot_players: HotKeys,
    attributes: Sequence[str] = ATTRIBUTES,
) -> DataFrame:
    """``strength_as_of`` with the attributes as a vector: averages are put in where the match is."""
    averages = averages_in(attributes)
    carried = [a for a in attributes if a not in averages]
    asking = dealt_by(lineups, "playerid", hot_players)
    offered = as_vector(scores, carried)
    known = as_of(asking, offered, ["teamid", "playerid"], "matchday", DAY, (VECTOR,), hot=hot_players)
    known = dealt_by(known.select("matchid", "teamid", "minutes", VECTOR), "matchid", hot_matches)
    at = {a: F.get(VECTOR, F.lit(i)) for i, a in enumerate(carried)}
    full = F.array(*[per_minute(*[at[c] for c in averages[a]]) if a in averages else at[a] for a in attributes])
    return _vector_sums(known.withColumn(VECTOR, full))


def team_vectors(known: DataFrame, player_time: DataFrame) -> DataFrame:
    """Per match and team, the sums of the players' vectors weighted by their minutes in the match."""
    return _vector_sums(with_minutes(known, player_time))


def _vector_sums(weighted: DataFrame) -> DataFrame:
    """As with single columns, unknown values do not count, and a sum of none is unknown. One aggregate
    adds up values and flags of all attributes.
    """
    values = F.transform(VECTOR, lambda a: F.coalesce(a * F.col("minutes"), F.lit(0.0)))
    flags = F.transform(VECTOR, lambda a: (a * F.col("minutes")).isNotNull().cast("double"))
    sums = weighted.groupBy("matchid", "teamid").agg(
        F.sum("minutes").alias("playtime"),
        Summarizer.sum(array_to_vector(F.concat(values, flags))).alias("_sums"),
    )
    both = sums.withColumn("_sums", vector_to_array("_sums"))
    half = (F.size("_sums") / 2).cast("int")
    pairs = F.arrays_zip(
        F.slice("_sums", F.lit(1), half).alias("total"), F.slice("_sums", half + 1, half).alias("known")
    )
    total = F.transform(pairs, lambda p: F.when(p["total"].isNotNull() & (p["known"] > 0), p["total"]))
    return both.select("matchid", "teamid", "playtime", total.alias(VECTOR))


def match_vectors(goals: DataFrame, strength: DataFrame) -> DataFrame:
    """Goals of a team with its own and its opponent's minutes and vector."""
    return _with_teams(goals, strength).select(
        *goals.columns,
        F.col("_own.playtime").alias("playtime"),
        F.col("_other.playtime").alias("opponent_playtime"),
        F.col(f"_own.{VECTOR}").alias(VECTOR),
        F.col(f"_other.{VECTOR}").alias(f"opponent_{VECTOR}"),
        F.year("matchday").alias("year"),
        F.month("matchday").alias("month"),
        F.dayofmonth("matchday").alias("day"),
    )


def match_vectors_norm(vectors: DataFrame) -> DataFrame:
    """Rows without NULLs, in columns or vectors, with the vectors per minute of the match."""
    both = (VECTOR, f"opponent_{VECTOR}")
    complete = vectors.na.drop()
    for name in both:
        complete = complete.filter(F.forall(name, lambda a: a.isNotNull()))
    scaled = {n: F.transform(n, lambda a: per_minute(a, "matchlength")) for n in both}
    return complete.withColumns(scaled)


def named(vectors: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Vectors back to a column per attribute, for tables that are looked at."""
    columns = []
    for c in vectors.columns:
        if c.endswith(VECTOR):
            prefix = c.removesuffix(VECTOR)
            columns += [F.get(c, F.lit(i)).alias(f"{prefix}{a}") for i, a in enumerate(attributes)]
        else:
            columns.append(F.col(c))
    return vectors.select(*columns)
