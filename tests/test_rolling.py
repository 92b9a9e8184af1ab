import random

import pytest
from conftest import as_set, day
from pyspark.sql import functions as F

from pitchlens import skew
from pitchlens.operators.rolling import as_of, group_total, last_x, running_sum

POINTS = "playerid bigint, matchid bigint, teamid bigint, matchday date, saison string, "
POINTS += "playtime bigint, off double, def bigint"


def random_points(spark, n=400, players=5, days=40, seed=7):
    rng = random.Random(seed)
    rows = []
    for matchid in range(n):
        player = 0 if rng.random() < 0.4 else rng.randrange(players)
        when = day(rng.randrange(days) * 20)
        rows.append(
            (player, matchid, 1, when, str(when.year), rng.randint(1, 90),
             float(rng.randint(0, 3)), -rng.randint(0, 3))
        )
    return rows, spark.createDataFrame(rows, POINTS)


def by_hand(rows, x, season):
    out = {}
    for t in rows:
        past = [h for h in rows if h[0] == t[0] and h[3] <= t[3] and (not season or h[4] == t[4])]
        past = sorted(past, key=lambda h: (h[3], h[1]), reverse=True)[:x]
        out[(t[0], t[1])] = (sum(h[5] for h in past), sum(h[6] for h in past), sum(h[7] for h in past))
    return out


@pytest.mark.parametrize("season", [False, True])
@pytest.mark.parametrize("floor", [10_000, 20])
def test_last_x_equals_brute_force(spark, floor, season):
    rows, df = random_points(spark)
    scope = ("playerid", "saison") if season else ("playerid",)
    found = skew.find_hot(df, ["playerid"], floor)
    assert (found.rows is not None) == (floor == 20)
    result = last_x(df, (1, 2, 5), scope=scope, floor_rows=floor).collect()
    assert len(result) == len(rows)
    for x in (1, 2, 5):
        expected = by_hand(rows, x, season)
        for row in result:
            got = (row[f"playtime_last_{x}"], row[f"total_off_last_{x}"], row[f"total_def_last_{x}"])
            assert got == expected[(row.playerid, row.matchid)]
            assert row[f"avg_off_last_{x}"] == pytest.approx(got[1] / got[0])


def test_matches_of_one_day_share_their_history(spark):
    rows = [(1, 1, 1, day(0), "2018", 90, 1.0, 0), (1, 2, 1, day(0), "2018", 45, 2.0, -1)]
    result = last_x(spark.createDataFrame(rows, POINTS), (1, 2))
    assert as_set(result, "matchid", "total_off_last_1", "total_off_last_2") == {
        (1, 2.0, 3.0),
        (2, 2.0, 3.0),
    }


@pytest.mark.parametrize("floor", [10_000, 20])
def test_running_sum_and_total(spark, floor):
    rows, df = random_points(spark)
    sums = running_sum(df, ["playerid"], "matchday", ["matchid"], {"s": "def"}, floor_rows=floor)
    totals = group_total(df, ["playerid"], {"t": "def"}, floor_rows=floor)
    got = {(r.playerid, r.matchid): r.s for r in sums.collect()}
    total = {(r.playerid, r.matchid): r.t for r in totals.collect()}
    assert len(got) == len(total) == len(rows)
    for p, m, _, d, *_ in rows:
        mine = [h for h in rows if h[0] == p]
        assert got[(p, m)] == sum(h[7] for h in mine if (h[3], h[1]) <= (d, m))
        assert total[(p, m)] == sum(h[7] for h in mine)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    _, df = random_points(spark)
    other = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "playerid bigint, name string")
    plain = df.join(other, ["playerid"], how)
    split = skew.split_join(df, other, ["playerid"], how, floor_rows=20)
    columns = ("playerid", "matchid", "name")
    assert as_set(split, *columns) == as_set(plain, *columns)
    hot = skew.find_hot(df, ["playerid"], 20)
    parts = {r.playerid: r.parts for r in hot.rows.collect()}
    counts = {r.playerid: r["count"] for r in df.groupBy("playerid").count().collect()}
    assert parts == {k: -(-n // 20) for k, n in counts.items() if n > 20}


def test_hot_keys_are_a_stored_table(spark):
    _, df = random_points(spark)
    found = skew.find_hot(df, ["playerid"], 1)
    assert found.number == found.rows.count() == df.select("playerid").distinct().count()
    assert found.rows.inputFiles()
    assert skew.find_hot(df, ["playerid"], 10_000).rows is None


NULLS = [  # playerid, teamid, saison, matchid, day, value
    (p, t, s, 10 * i + p if p else i, None if i % 7 == 3 else day(i % 4), None if i % 3 == 0 else i)
    for i in range(40)
    for p, t, s in [((1, 2, None)[i % 3], (5, None)[i % 5 == 4], ("2017", None)[i % 4 == 1])]
]
NULL_COLUMNS = "playerid bigint, teamid bigint, saison string, matchid bigint, matchday date, v bigint"


def both_ways(make, columns):
    """The rows of a plan with no hot key and with nearly all keys hot."""
    cold, hot = (make(floor).select(*columns).collect() for floor in (10_000, 3))
    assert sorted(map(str, cold)) == sorted(map(str, hot))
    return cold


def test_missing_keys_and_values_do_not_depend_on_size(spark):
    df = spark.createDataFrame(NULLS, NULL_COLUMNS)
    points = df.selectExpr("*", "90L as playtime", "v as off", "-v as def")
    for scope in (("playerid",), ("playerid", "saison")):
        rows = both_ways(
            lambda floor: last_x(points, (1, 3), scope=scope, keep=["saison"], floor_rows=floor),
            ["playerid", "saison", "matchid", "target_match_timestamp", "playtime_last_3", "total_off_last_3"],
        )
        assert rows and all(r.playerid is not None for r in rows)
        assert scope == ("playerid",) or all(r.saison is not None for r in rows)
    sums = both_ways(
        lambda floor: running_sum(df, ["playerid"], "matchday", ["matchid", "v"], {"s": "v"}, floor_rows=floor),
        ["playerid", "matchid", "matchday", "v", "s"],
    )
    assert len(sums) == len(NULLS) and any(r.s is None for r in sums)
    both_ways(
        lambda floor: group_total(df, ["playerid"], {"t": "v"}, floor_rows=floor), ["playerid", "matchid", "t"]
    )
    scores = df.selectExpr("playerid", "teamid", "matchid", "matchday as score_date", "v")
    asked = df.selectExpr("playerid", "teamid", "matchid", "matchday + interval 1 day as matchday", "saison")
    asked = asked.withColumn("matchday", F.col("matchday").cast("date"))
    found = both_ways(
        lambda floor: as_of(
            asked, scores, ["teamid", "playerid"], "matchday", "score_date", ["v"], floor_rows=floor
        ),
        ["playerid", "teamid", "matchid", "_as_of", "v"],
    )
    assert found and all(r.playerid is not None and r.teamid is not None for r in found)


@pytest.mark.parametrize("floor", [1000, 2])
def test_as_of_is_strictly_before(spark, floor):
    scores = spark.createDataFrame(
        [(1, 7, 100, day(0), 1.0), (1, 7, 101, day(3), 2.0), (1, 7, 102, day(9), 3.0)],
        "teamid bigint, playerid bigint, matchid bigint, score_date date, v double",
    )
    asked = spark.createDataFrame(
        [(101, 1, 7, day(3)), (200, 1, 7, day(5)), (100, 1, 7, day(0)), (201, 1, 8, day(5))],
        "matchid bigint, teamid bigint, playerid bigint, matchday date",
    )
    got = as_of(asked, scores, ["teamid", "playerid"], "matchday", "score_date", ["v"], floor_rows=floor)
    assert as_set(got, "matchid", "_as_of", "v") == {(101, day(0), 1.0), (200, day(3), 2.0)}


def test_cold_plan_has_one_shuffle(spark):
    _, df = random_points(spark)
    plan = last_x(df.filter(F.col("playerid") >= 0), (1, 5), hot=skew.HotKeys(("playerid",)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
