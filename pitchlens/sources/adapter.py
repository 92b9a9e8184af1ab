"""Football tables derived from an orders / lineitem data set.

Integer, date and string expressions only, so that the same definitions in another SQL engine
give exactly the same tables. Column definitions are listed in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.functions.scalars import POSITION_KINDS
from pitchlens.schema import Tables
from pitchlens.skew import dealt_by, find_hot
from pitchlens.staging import stage


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    home = F.col("o_custkey") % 25
    return _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("matchid"),
        day.alias("matchday"),
        F.year(day).cast("string").alias("saison"),
        F.col("o_orderpriority").alias("tournament"),
        F.col("o_orderstatus").alias("country"),
        (F.lit(90) + 10 * (F.col("o_orderkey") % 4)).cast("int").alias("matchlength"),
        home.alias("hometeam"),
        ((home + 1 + F.col("o_orderkey") % 24) % 25).alias("guestteam"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 20).alias("refereeid"),
    )


def appearances(spark: SparkSession, folder: str, match: DataFrame) -> DataFrame:
    """One row per order and supplier. Line items are combined before they meet the match.

    They are dealt out by order once, for both; orders with too many of them for one task are combined first.
    """
    lines = _read(spark, folder, "lineitem").dropna(subset=["l_orderkey"])
    per_supplier = (
        dealt_by(lines, "l_orderkey", find_hot(lines, ["l_orderkey"]))
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.min("l_linenumber").alias("line"),
            F.min("l_quantity").cast("int").alias("qty"),
            F.round(F.min("l_discount") * 100).cast("int").alias("disc"),
            F.round(F.min("l_tax") * 100).cast("int").alias("tax"),
            # One-letter flags; as numbers they aggregate by hash, as text only by sorting.
            F.min(F.ascii("l_returnflag")).alias("rf"),
            F.min(F.ascii("l_linestatus")).alias("ls"),
        )
    )
    sides = match.select("matchid", "hometeam", "guestteam")
    return per_supplier.join(sides, per_supplier.l_orderkey == sides.matchid).select(
        "matchid",
        (F.col("l_suppkey") * 2).alias("playerid"),
        F.when(F.col("line") % 2 == 1, F.col("hometeam"))
        .otherwise(F.col("guestteam"))
        .alias("teamid"),
        "qty",
        "disc",
        "tax",
        F.chr(F.col("rf")).alias("rf"),
        F.chr(F.col("ls")).alias("ls"),
    )


def tables_from_orders(spark: SparkSession, folder: str) -> Tables:
    """The football tables of an orders data set.

    Line-up, substitutions, cards and goals all come from the appearances, which are therefore
    written to the shared folder once, as a loader would, and scanned from there.
    """
    match = matches(spark, folder)
    seen = stage(appearances(spark, folder, match), "appearances")
    player = seen.select("playerid", "matchid", "teamid")
    substitution = seen.filter((F.col("ls") == "F") & (F.col("disc") < 5)).select(
        "matchid",
        "teamid",
        (F.col("playerid") + 1).alias("playerin"),
        F.col("playerid").alias("playerout"),
        F.when(F.col("qty") != 50, 45 + F.col("qty") % 40).cast("int").alias("time"),
    )
    card = seen.filter(F.col("rf") == "R").select(
        "matchid",
        "teamid",
        "playerid",
        F.when(F.col("disc") >= 9, "red")
        .when(F.col("disc") >= 8, "yellowred")
        .otherwise("yellow")
        .alias("color"),
        (20 + F.col("qty")).cast("int").alias("time"),
    )
    goal = seen.filter(F.col("tax") >= 4).select(
        "matchid",
        "teamid",
        (1 + (F.col("qty") * 3) % 90).cast("int").alias("time"),
        F.when(F.col("tax") != 8, F.col("playerid")).alias("scorer"),
        F.lit(None).cast("bigint").alias("assist"),
        (F.col("tax") == 8).alias("own_goal"),
    )
    team = _read(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("teamid"), F.col("n_name").alias("teamname")
    )
    positions = F.array(*[F.lit(p) for p in [*POSITION_KINDS, "Unbekannt"]])
    profile = _read(spark, folder, "part").select(
        F.col("p_partkey").alias("playerid"),
        F.col("p_name").alias("playername"),
        F.when(
            F.col("p_size") % 10 != 0,
            F.date_add(F.to_date(F.lit("1960-01-01")), F.col("p_size") * 300),
        ).alias("birthdate"),
        F.col("p_brand").alias("nationality"),
        F.get(positions, (F.col("p_partkey") % 18).cast("int")).alias("position"),
    )
    customer = _read(spark, folder, "customer")
    referee = customer.filter(F.col("c_custkey") < 20).select(
        F.col("c_custkey").alias("refereeid"), F.col("c_name").alias("refereename")
    )
    trainer = match.select(
        F.explode(F.array("hometeam", "guestteam")).alias("team"),
        F.col("matchid").alias("match"),
        (F.col("saison").cast("int") % 4).alias("shift"),
    ).select((F.col("team") * 4 + F.col("shift")).alias("trainer"), "team", "match")
    trainer_name = customer.filter(F.col("c_custkey") < 100).select(
        F.col("c_custkey").alias("trainer"), F.col("c_name").alias("trainername")
    )
    return Tables(
        match=match,
        player=player,
        substitution=substitution,
        card=card,
        goal=goal,
        team=team,
        profile=profile,
        referee=referee,
        trainer=trainer,
        trainer_name=trainer_name,
    )
