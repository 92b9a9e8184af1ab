"""When each player was on the pitch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.schema import Tables
from pitchlens.skew import dealt_by, split_join

# Card colours that end a player's match.
DISMISSALS = ("red", "yellowred")

ENTRY = ["playerid", "matchid", "teamid"]


# Marks of an event whose minute is unknown, and of a dismissal.
_CAME, _WENT, _SENT_OFF = 1, 2, 4


def _events(df: DataFrame, player: str, came=None, went=None, sent=None, mark=None) -> DataFrame:
    def minute(c):
        return F.lit(None).cast("int") if c is None else c.cast("int")

    return df.select(
        F.col(player).alias("playerid"),
        "matchid",
        "teamid",
        minute(came).alias("came"),
        minute(went).alias("went"),
        minute(sent).alias("sent"),
        (F.lit(0) if mark is None else mark).cast("int").alias("mark"),
    )


def entries(tables: Tables, by_match: bool = False, parts: int | None = None) -> DataFrame:
    """One row per player, match and team: the minutes they came on, went off and were sent off.

    Line-up, substitutions and cards are stacked and combined in a single shuffle. The sets hold
    distinct minutes, so they are bounded by the length of a match however many rows come in. With
    ``by_match`` that shuffle deals them out by match, for joins with what else belongs to one (to ``parts``, if given).
    """
    minute = F.col("time")

    def unknown(mark: int):
        return F.when(minute.isNull(), mark).otherwise(0)

    changes = tables.substitution
    leaving = changes.dropna(subset=["playerout", "matchid", "teamid"])
    dismissals = tables.card.filter(F.col("color").isin(*DISMISSALS)).dropna(subset=ENTRY)
    events = (
        _events(tables.player, "playerid", came=F.lit(0))
        .unionByName(_events(changes, "playerin", came=minute, mark=unknown(_CAME)))
        .unionByName(_events(leaving, "playerout", went=minute, mark=unknown(_WENT)))
        .unionByName(_events(dismissals, "playerid", sent=minute, mark=F.lit(_SENT_OFF)))
    )
    if by_match:
        events = dealt_by(events, "matchid", tables.hot_matches, parts)
    nothing = F.array().cast("array<int>")
    unknown_minute = F.array(F.lit(None).cast("int"))

    def marked(mark: int):
        return F.col("marks").bitwiseAND(mark) != 0

    usual = tables.usual_minutes
    rows = events.groupBy(*ENTRY).agg(
        *(_bits("came") + _bits("went") if usual else [F.collect_set("came").alias("came"), F.collect_set("went").alias("went")]),
        F.min("sent").alias("card_time"),
        F.bit_or("mark").alias("marks"),
    )
    came, went = (_minutes(c) if usual else F.col(c) for c in ("came", "went"))
    return rows.select(
        *ENTRY,
        F.concat(came, F.when(marked(_CAME), unknown_minute).otherwise(nothing)).alias("ins"),
        went.alias("outs"),
        marked(_WENT).alias("open_out"),
        marked(_SENT_OFF).alias("dismissed"),
        "card_time",
    ).filter(F.size("ins") > 0)


def _bits(minute: str) -> list[Column]:
    """Aggregates that tell the distinct usual minutes: a bit for each, and the first and the last.

    Numbers aggregate by hash, sets only by sorting.
    """
    bit = [F.when(F.floor(F.col(minute) / 64) == i, F.expr(f"shiftleft(1L, {minute} % 64)")) for i in range(2)]
    return [
        F.min(minute).alias(f"{minute}_first"),
        F.max(minute).alias(f"{minute}_last"),
        *[F.coalesce(F.bit_or(b), F.lit(0).cast("long")).alias(f"{minute}_{i}") for i, b in enumerate(bit)],
    ]


def _minutes(minute: str) -> Column:
    """The distinct minutes of ``_bits`` as an array."""
    first, last = F.col(f"{minute}_first"), F.col(f"{minute}_last")
    n = F.bit_count(f"{minute}_0") + F.bit_count(f"{minute}_1")
    listed = F.expr(
        f"""
        filter(sequence({minute}_first, {minute}_last), m ->
            (shiftright(if(m < 64, {minute}_0, {minute}_1), m % 64) & 1L) = 1L)
        """
    )
    empty = F.array().cast("array<int>")
    return F.when(n == 0, empty).when(n == 1, F.array(first)).when(n == 2, F.array(first, last)).otherwise(listed)


def presence(tables: Tables, matches: DataFrame | None = None) -> DataFrame:
    """One row per player, match and team with ``spells``, an array of their times on the pitch.

    A player who was not substituted (or whose minute of going off is unknown) stays until a
    dismissal or the end of the match. All columns of ``matches`` come along; give a frame with
    further columns per match to have them here without another join.
    """
    matches = tables.match if matches is None else matches
    joined = split_join(
        entries(tables, by_match=True) if tables.stored_entries is None else tables.stored_entries,
        matches,
        ["matchid"],
        hot=tables.hot_matches,
        spread_by=["playerid", "teamid"],
    )
    stays = (F.size("outs") == 0) | F.col("open_out")
    closing = F.when(F.col("dismissed"), F.col("card_time")).otherwise(F.col("matchlength"))
    ends = F.array_union(
        F.col("outs"),
        F.when(stays, F.array(closing)).otherwise(F.array().cast("array<int>")),
    )
    spells = F.expr(
        """
        flatten(transform(ins, i -> transform(ends, o -> named_struct(
            'in_time', i,
            'out_time', o,
            'playtime', if(coalesce(o <> i, false), o - i, 1)))))
        """
    )
    return (
        joined.withColumn("ends", ends)
        .withColumn("spells", spells)
        .drop("ins", "outs", "open_out", "dismissed", "card_time", "ends")
    )


def player_time(tables: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    """Times on the pitch: playerid, matchid, teamid, in_time, out_time, playtime.

    Both ends belong to the interval. ``keep`` names columns of the match to carry along.
    """
    return presence(tables).select(*ENTRY, *keep, F.inline("spells"))


def presence_of(stored: DataFrame) -> DataFrame:
    """Stored player times (one row per spell) back to one row per player, match and team."""
    return stored.groupBy(*ENTRY).agg(
        F.collect_set(F.struct("in_time", "out_time", "playtime")).alias("spells")
    )


def playtime_by_season(tables: Tables) -> DataFrame:
    return (
        player_time(tables, keep=("tournament", "saison"))
        .groupBy("playerid", "teamid", "tournament", "saison")
        .agg(F.sum("playtime").alias("playtimes"))
    )
