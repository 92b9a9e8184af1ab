"""Ranked points: goals weighted by how strong the opponents on the pitch have been."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import NEUTRAL, RANKED, avg_col, playtime_col
from pitchlens.operators.neutral import goal_minutes, match_presence
from pitchlens.operators.pitch_time import ENTRY
from pitchlens.operators.rolling import last_x
from pitchlens.schema import Tables
from pitchlens.skew import dealt_by, split_join
from pitchlens.staging import discard, stage

SEASON = ("playerid", "saison")

#: Stores a frame under a label and returns it read back.
Store = Callable[[DataFrame, str], DataFrame]


def _form(tables: Tables, x: int, store: Store) -> DataFrame:
    """Every player and match with the player's averages over the last X matches of the season.

    The joins below read it twice, so it is stored by ``store``. Goals are joined by match later: they need not
    travel with every player's row, nor need the minutes of a spell, which are in its ends.
    """
    ends = F.transform("spells", lambda s: F.struct(s["in_time"].alias("in_time"), s["out_time"].alias("out_time")))
    form = last_x(
        dealt_by(match_presence(tables).withColumn("spells", ends), "playerid", tables.hot_players),
        (x,),
        (NEUTRAL,),
        scope=SEASON,
        keep=["tournament", "playtime", "off", "def", "spells"],
        hot=tables.hot_players,
    )
    return store(
        form.select(
            *ENTRY,
            "saison",
            "tournament",
            F.col("target_match_timestamp").alias("matchday"),
            "playtime",
            "off",
            "def",
            "spells",
            F.col(avg_col("off", x)).alias("off_form"),
            F.col(avg_col("def", x)).alias("def_form"),
        ),
        "form",
    )


def _goal_weights(form: DataFrame, tables: Tables) -> DataFrame:
    """Per match, ``weights``: for each goal minute and side, the summed form on the pitch.

    For the scoring side it is the offensive form of its players on the pitch, for any other
    side the defensive form. Goals of one team in the same minute make one entry, in which every
    player counts once per goal. The array is bounded by the minutes of a match.
    """
    present = split_join(
        form.select("matchid", "playerid", F.col("teamid").alias("side"), "spells", "off_form", "def_form"),
        goal_minutes(tables).drop("n_unnamed"),
        ["matchid"],
        hot=tables.hot_matches,
        spread_by=["playerid", "side"],
    )
    times = F.expr("size(filter(spells, s -> time between s.in_time and s.out_time))")
    form_of_side = F.when(F.col("side") == F.col("teamid"), F.col("off_form")).otherwise(
        F.col("def_form")
    )
    return (
        present.withColumn("times", times)
        .filter(F.col("times") > 0)
        .groupBy("matchid", F.col("teamid").alias("scoring"), "side", "time")
        .agg(F.sum(form_of_side * F.col("n") * F.col("times")).alias("weight"))
        .filter(F.col("weight").isNotNull())
        .groupBy("matchid")
        .agg(F.collect_list(F.struct("scoring", "side", "time", "weight")).alias("weights"))
    )


def _weights_on_pitch(own: bool) -> Column:
    """Weights of the goals a player was there for.

    The own side's goals weigh as much as the defence they beat, goals of others as much as the
    attack behind them.
    """
    side = "w.scoring = teamid and w.side <> teamid"
    if not own:
        side = "w.scoring <> teamid and w.side = w.scoring"
    return F.expr(
        f"""
        flatten(transform(spells, s -> transform(
            filter(coalesce(weights, array()),
                w -> {side} and w.time between s.in_time and s.out_time),
            w -> w.weight)))
        """
    )


def credited(tables: Tables, x: int = 1, store: Store = stage) -> DataFrame:
    """Each player and match with the weights of the goals ``scored`` and ``conceded`` meanwhile.

    The table is stored: both baselines and the points come from it, so the join with the goals of
    the match runs once. ``x`` is the number of matches that the form of the opponents is taken from;
    ``store`` keeps a frame as a table (by match, where the tables are laid out by it).
    """
    form = _form(tables, x, store)
    joined = split_join(
        form,
        _goal_weights(form, tables),
        ["matchid"],
        "left",
        hot=tables.hot_matches,
        spread_by=["playerid", "teamid"],
    )
    stored = store(
        joined.withColumn("scored", _weights_on_pitch(own=True))
        .withColumn("conceded", _weights_on_pitch(own=False))
        .drop("weights", "spells", "off_form", "def_form"),
        "credited",
    )
    if store is stage:
        discard(form)
    return stored


def _above(weights: str, baseline: Column) -> Column:
    """Sum of the weights, each taken relative to the baseline; 0 without goals."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.coalesce(total - F.size(weights) * baseline, F.lit(0.0))


def ranked_points(tables: Tables, x: int = 1, stored: DataFrame | None = None) -> DataFrame:
    """Neutral and ranked points per player, match and team.

    A goal's weight is measured from a baseline: the lowest defensive form sum any goal was
    scored against, and the highest offensive form sum behind any goal. So ranked offensive
    points are never negative and ranked defensive points never positive. Both baselines come from
    one pass over the stored weights (``stored``, the result of ``credited`` for the same ``x``, is made
    when not given); without goals all ranked points are 0.
    """
    weights = credited(tables, x) if stored is None else stored
    ends = weights.agg(
        F.min(F.array_min("scored")).alias("lowest"), F.max(F.array_max("conceded")).alias("highest")
    ).first()
    points = weights.withColumn(RANKED.off, _above("scored", F.lit(ends.lowest).cast("double")))
    points = points.withColumn(RANKED.deff, _above("conceded", F.lit(ends.highest).cast("double")))
    return points.select(
        *ENTRY,
        "saison",
        "tournament",
        "matchday",
        "playtime",
        "off",
        "def",
        RANKED.off,
        RANKED.deff,
        (F.col(RANKED.off) + F.col(RANKED.deff)).alias(RANKED.diff),
    )


def neutral_ranked_last_x(
    tables: Tables,
    xs: Sequence[int] = (1,),
    form_x: int | None = None,
    stored: DataFrame | None = None,
    compat: bool = False,
    by_player: bool = False,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """Neutral and ranked rolling columns side by side, both over the matches of the season.

    As both use the same histories, they come from the same windows and need no join. The form is
    that of the largest X unless ``form_x`` says otherwise. With ``compat`` the neutral history is the
    whole career, and of each player and match only those X are joined whose playtimes in both
    histories are equal, one X at a time. With ``by_player`` rows stay dealt out by player, for windows to come.
    With ``seasons`` only their rows are made; no other season's are in their histories, but all count for
    the baselines of the points.
    """
    xs = sorted(xs)
    points = ranked_points(tables, xs[-1] if form_x is None else form_x, stored)
    if seasons is not None:
        if compat:
            raise ValueError("the history over the career needs all seasons")
        points = points.filter(F.col("saison").isin(list(seasons)))
    if by_player:
        points = dealt_by(points, "playerid", tables.hot_players)
    if not compat:
        return last_x(
            points, xs, (NEUTRAL, RANKED), scope=SEASON, keep=["tournament"], hot=tables.hot_players
        )
    if len(xs) != 1:
        raise ValueError("the join on equal playtime is defined for a single X")
    if tables.hot_players.rows is None:
        return _equal_playtimes(dealt_by(points, "playerid", tables.hot_players), xs, tables)
    keep = ["saison", "tournament"]
    career = last_x(points, xs, (NEUTRAL,), keep=keep, hot=tables.hot_players)
    season = last_x(points, xs, (RANKED,), scope=SEASON, keep=keep[1:], hot=tables.hot_players)
    return career.join(season, [*ENTRY, *keep, "target_match_timestamp", playtime_col(xs[0])])


def _equal_playtimes(points: DataFrame, xs: Sequence[int], tables: Tables) -> DataFrame:
    """The join of both histories on rows that are dealt out by player, without another shuffle.

    The season's history is added to the rows of the career's. Where a player has several rows in a match
    and team, each meets the season's values of all of them.
    """
    minutes, day = playtime_col(xs[0]), "target_match_timestamp"
    keys = [*ENTRY, "saison", "tournament", day]
    raw = ["playtime", RANKED.off, RANKED.deff]
    career = last_x(points, xs, (NEUTRAL,), keep=[*keys[3:5], *raw], hot=tables.hot_players)
    own = [c for c in career.columns if c not in (*keys, *raw, minutes)]
    both = last_x(
        career.withColumnsRenamed({day: "matchday", minutes: "_minutes"}),
        xs,
        (RANKED,),
        scope=SEASON,
        keep=["tournament", "_minutes", *own],
        hot=tables.hot_players,
    ).dropna(subset=keys)
    ranked = [c for c in both.columns if c not in (*keys, "_minutes", *own)]
    of_entry = F.collect_list(F.struct(*ranked)).over(W.partitionBy(*keys))
    met = both.withColumn("_ranked", of_entry).select(*keys, "_minutes", *own, F.inline("_ranked"))
    met = met.filter(F.col("_minutes") == F.col(minutes))
    return met.select(*keys, minutes, *own, *[c for c in ranked if c != minutes])


def ranked_last_x(
    tables: Tables,
    xs: Sequence[int] = (1,),
    form_x: int | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    xs = sorted(xs)
    points = ranked_points(tables, xs[-1] if form_x is None else form_x, stored)
    return last_x(
        points.drop("off", "def"),
        xs,
        (RANKED,),
        scope=SEASON,
        keep=["tournament"],
        hot=tables.hot_players,
    )
