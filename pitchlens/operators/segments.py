"""Stretches of a match in which a side conceded no goal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.operators.neutral import match_facts
from pitchlens.operators.pitch_time import ENTRY, presence
from pitchlens.schema import Tables

# Length of a segment, and the minute the last one ends.
SEGMENT_MINUTES = 5
LAST_MINUTE = 120

# A bit for each segment that holds a goal conceded.
_HIT = f"""
    aggregate(filter(conceded, g -> g.time between 1 and {LAST_MINUTE}), 0L,
        (bits, g) -> bits | shiftleft(1L, cast((g.time - 1) div {SEGMENT_MINUTES} as int)))
"""


def goalless_segments(tables: Tables, compat: bool = False) -> DataFrame:
    """Segments without a goal of the other side, for each player present all through.

    A goal at minute t lies in the segment (from, to] that holds t. With ``compat``, a goal
    without a scorer does not count as one: its segment is listed once per such goal.
    The fan-out is bounded by the number of segments of a match; no join is needed, as every
    row carries the goals of its match. Segments with a goal are told by the bits of a number, one for
    each, which is made once per player and match.
    """
    conceded = F.expr("filter(coalesce(goals, array()), g -> g.teamid <> teamid)")
    rows = (
        presence(tables, match_facts(tables))
        .filter(F.col("teamid").isin(F.col("hometeam"), F.col("guestteam")))
        .withColumn("conceded", conceded)
        .select(
            *ENTRY,
            "matchlength",
            F.col("matchday").alias("target_match_timestamp"),
            "conceded",
            F.expr(_HIT).alias("hit"),
            F.inline("spells"),
        )
    )
    # Only the whole segments between coming on and going off (or the end of the match) are made.
    known = rows.dropna(subset=["in_time", "out_time", "matchlength"])
    minutes = F.lit(SEGMENT_MINUTES)
    first = (F.ceil(F.greatest("in_time", F.lit(0)) / minutes) * minutes).cast("int")
    end = F.least("out_time", "matchlength", F.lit(LAST_MINUTE))
    last = ((F.floor(end / minutes) - 1) * minutes).cast("int")
    cut = (
        known.filter(last >= first)
        .withColumn("segment_from", F.explode(F.sequence(first, last, minutes)))
        .withColumn("segment_to", F.col("segment_from") + SEGMENT_MINUTES)
    )
    clear = F.expr(f"shiftright(hit, segment_from div {SEGMENT_MINUTES}) & 1L") == 0
    if compat:
        unnamed = F.expr(
            """
            aggregate(conceded, 0L, (total, g) -> total
                + if(g.time > segment_from and g.time <= segment_to, g.n_unnamed, 0L))
            """
        )
        kept = cut.withColumn("copies", F.when(clear, 1).otherwise(unnamed.cast("int"))).filter(F.col("copies") > 0)
        kept = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    else:
        kept = cut.filter(clear)
    return kept.select(
        *ENTRY,
        "target_match_timestamp",
        "matchlength",
        "segment_from",
        "segment_to",
        "in_time",
        "out_time",
        "playtime",
    )
