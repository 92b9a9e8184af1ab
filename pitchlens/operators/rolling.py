"""Per-player histories: sums over the last X matches, running sums, values as of a day.

A player may hold a large part of all rows. What these operators need from a player's history
is one entry per day (or the few latest matches of a day), and days are bounded by the calendar.
So players that fit one task go through plain windows, and the hot ones are first reduced to
their days, with the per-day work spread over tasks by (player, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlens.functions.columns import (
    DEFAULT_XS,
    NEUTRAL,
    Family,
    avg_col,
    playtime_col,
    total_col,
)
from pitchlens.functions.scalars import per_minute
from pitchlens.skew import HotKeys, by_key_size, find_hot, split_join

# Matches of one day are told apart by id, so that ties always fall the same way.
MATCH_ORDER = ["matchid", "teamid"]


def last_x(
    points: DataFrame,
    xs: Sequence[int] = DEFAULT_XS,
    families: Sequence[Family] = (NEUTRAL,),
    scope: Sequence[str] = ("playerid",),
    keep: Sequence[str] = (),
    hot: HotKeys | None = None,
    floor_rows: int | None = None,
) -> DataFrame:
    """For each row of ``points``, totals over the player's X latest matches up to that day.

    ``points`` has playerid, matchid, teamid, matchday, playtime and the columns of ``families``.
    Matches of the same day count as history for one another. ``scope`` says where a history
    ends: the career (``playerid``) or the season (``playerid, saison``). All X share the same
    windows. ``keep`` names further columns to carry along, ``hot`` the players that are too
    large for one task (found from ``points`` when not given). Rows without a day, a player or
    another key of the scope belong to no history and are left out.
    """
    xs = sorted(xs)
    scope = list(scope)
    day = [*scope, "matchday"]
    sums = [("playtime", playtime_col)]
    sums += [(n, lambda x, n=n: total_col(n, x)) for f in families for n in (f.off, f.deff)]

    types = points.agg(*[F.sum(name).alias(name) for name, _ in sums]).schema

    def total(name: str, x: int, history: W) -> Column:
        # The last match alone is the row itself: no window is needed for it.
        if x == 1:
            return (F.lit(0) + F.col(name)).cast(types[name].dataType)
        return F.sum(name).over(history.rowsBetween(-(x - 1), 0))

    def totals(history: W) -> list:
        return [total(name, x, history).alias(label(x)) for x in xs for name, label in sums]

    def usual(df: DataFrame) -> DataFrame:
        history = W.partitionBy(*scope).orderBy("matchday", *MATCH_ORDER)
        same_day = (
            W.partitionBy(*day)
            .orderBy(*MATCH_ORDER)
            .rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        )
        summed = df.select("*", F.struct(*totals(history)).alias("_sums"))
        return summed.withColumn("_sums", F.last("_sums").over(same_day)).select(
            *df.columns, "_sums.*"
        )

    def heavy(df: DataFrame) -> DataFrame:
        # The rank filter is applied before the shuffle too, so at most max(xs) rows per player
        # and day leave each task.
        latest_first = W.partitionBy(*day).orderBy(*[F.desc(c) for c in MATCH_ORDER])
        recent = df.withColumn("_rank", F.row_number().over(latest_first)).filter(
            F.col("_rank") <= max(xs)
        )
        history = W.partitionBy(*scope).orderBy("matchday", F.desc("_rank"))
        per_day = (
            recent.select(*day, "_rank", *totals(history)).filter(F.col("_rank") == 1).drop("_rank")
        )
        return df.join(per_day, day)

    measured = ["playtime"] + [n for f in families for n in (f.off, f.deff)]
    fixed = list(dict.fromkeys(["playerid", "matchid", "teamid", "matchday", *scope, *keep]))
    rows = points.dropna(subset=["playerid", "matchday", *scope]).select(
        *fixed, *[c for c in measured if c not in fixed]
    )
    summed = by_key_size(rows, ["playerid"], usual, heavy, hot=hot, floor_rows=floor_rows)
    diffs = {
        total_col(f.diff, x): F.col(total_col(f.off, x)) + F.col(total_col(f.deff, x))
        for x in xs
        for f in families
    }
    summed = summed.withColumns(diffs)
    columns = []
    for x in xs:
        columns.append(playtime_col(x))
        columns += [total_col(n, x) for f in families for n in f.names]
        columns += [
            per_minute(total_col(n, x), playtime_col(x)).alias(avg_col(n, x))
            for f in families
            for n in f.names
        ]
    carried = [c for c in fixed if c != "matchday"]
    return summed.select(
        *carried, F.col("matchday").alias("target_match_timestamp"), *columns
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    order: Sequence[str],
    sums: dict[str, str],
    hot: HotKeys | None = None,
    floor_rows: int | None = None,
) -> DataFrame:
    """Add the running sums ``{new column: value column}`` per key, ordered by day and ``order``.

    A sum is NULL until the first value comes; rows without a day come first. For hot keys each
    day's total is formed first; a row's running sum is the total of all earlier days plus the
    rows of its own day up to it.
    """
    keys, order = list(keys), list(order)

    def usual(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(day, *order)
        w = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        return part.withColumns({new: F.sum(value).over(w) for new, value in sums.items()})

    def heavy(part: DataFrame) -> DataFrame:
        per_day = part.groupBy(*keys, day).agg(
            *[F.sum(value).alias(f"_{new}") for new, value in sums.items()]
        )
        earlier = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
        before = per_day.withColumns(
            {f"_{new}": F.sum(f"_{new}").over(earlier) for new in sums}
        ).withColumnRenamed(day, "_day")
        today = W.partitionBy(*keys, day).orderBy(*order)
        today = today.rowsBetween(W.unboundedPreceding, W.currentRow)
        within = part.withColumns({new: F.sum(value).over(today) for new, value in sums.items()})
        before = before.withColumnsRenamed({key: f"_key_{key}" for key in keys})
        same = F.col(day).eqNullSafe(F.col("_day"))
        for key in keys:
            same = same & (F.col(key) == F.col(f"_key_{key}"))
        both = {
            new: F.when(
                F.col(new).isNotNull() | F.col(f"_{new}").isNotNull(),
                F.coalesce(new, F.lit(0)) + F.coalesce(f"_{new}", F.lit(0)),
            )
            for new in sums
        }
        return within.join(before, same).select(
            *part.columns,
            *[both[new].cast(within.schema[new].dataType).alias(new) for new in sums],
        )

    return by_key_size(df, keys, usual, heavy, hot=hot, floor_rows=floor_rows)


def group_total(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, str],
    hot: HotKeys | None = None,
    spread_by: Sequence[str] = (),
    floor_rows: int | None = None,
) -> DataFrame:
    """Add to every row the totals ``{new column: value column}`` of its key.

    Rows without a key are a group of their own.
    """
    keys = list(keys)

    def usual(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys)
        return part.withColumns({new: F.sum(value).over(w) for new, value in sums.items()})

    def heavy(part: DataFrame) -> DataFrame:
        totals = part.groupBy(*keys).agg(*[F.sum(v).alias(new) for new, v in sums.items()])
        return split_join(part, totals, keys, hot=hot, spread_by=spread_by).select(
            *part.columns, *sums
        )

    if hot is None:
        hot = find_hot(df, keys, floor_rows)
    return by_key_size(df, keys, usual, heavy, hot=hot)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    day: str,
    right_day: str,
    values: Sequence[str],
    hot: HotKeys | None = None,
    floor_rows: int | None = None,
) -> DataFrame:
    """The latest ``right`` row strictly before each ``left`` row's day, per key.

    Rows of ``left`` without an earlier one, without a day or without a key are dropped; of several
    right rows on one day the one with the highest id counts. Both sides are stacked and sorted once per key, asking rows
    before the offered ones of their day, so no join is needed. For hot keys both sides are
    reduced to one entry per day first, and the answers joined back by (key, day). ``hot`` may
    name fewer keys; by default it is found from ``left`` and ``right`` together.
    """
    keys = list(keys)
    known = F.struct(F.col(right_day).alias("_as_of"), *values)
    asking = left.dropna(subset=[*keys, day])
    right = right.dropna(subset=[*keys, right_day])
    known_type = right.select(known.alias("k")).schema["k"].dataType
    # One frame with both: asking rows carry their own columns, offered rows only what they offer.
    rows = asking.withColumn("_offered", F.lit(False)).withColumn(
        "_known", F.lit(None).cast(known_type)
    )
    offers = right.select(
        *keys,
        *[c for c in MATCH_ORDER if c not in keys],
        F.col(right_day).alias(day),
        known.alias("_known"),
        F.lit(True).alias("_offered"),
    )
    rows = rows.unionByName(offers, allowMissingColumns=True)
    out = [*left.columns, "_found.*"]

    def usual(part: DataFrame) -> DataFrame:
        line = W.partitionBy(*keys).orderBy(day, "_offered", *MATCH_ORDER)
        before = line.rowsBetween(W.unboundedPreceding, -1)
        found = part.withColumn("_found", F.last("_known", ignorenulls=True).over(before))
        return found.filter(~F.col("_offered") & F.col("_found").isNotNull()).select(*out)

    def heavy(part: DataFrame) -> DataFrame:
        # Offers of a day are ranked before the shuffle too: one per day and task leaves.
        latest_first = W.partitionBy(*keys, day).orderBy(*[F.desc(c) for c in MATCH_ORDER])
        offered = (
            part.filter("_offered")
            .withColumn("_rank", F.row_number().over(latest_first))
            .filter("_rank = 1")
            .select(*keys, day, "_known", F.lit(True).alias("_offered"))
        )
        asked = part.filter(~F.col("_offered")).select(*keys, day).distinct()
        days = offered.unionByName(
            asked.withColumn("_offered", F.lit(False)), allowMissingColumns=True
        )
        line = W.partitionBy(*keys).orderBy(day, "_offered")
        before = line.rowsBetween(W.unboundedPreceding, -1)
        answers = (
            days.withColumn("_found", F.last("_known", ignorenulls=True).over(before))
            .filter(~F.col("_offered") & F.col("_found").isNotNull())
            .select(*keys, day, "_found")
        )
        return part.filter(~F.col("_offered")).join(answers, [*keys, day]).select(*out)

    if hot is None:
        hot = find_hot(rows, keys, floor_rows)
    return by_key_size(rows, list(hot.keys), usual, heavy, hot=hot)
