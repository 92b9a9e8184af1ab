import datetime
import random

from conftest import as_set, day

from pitchlens.model import features, training
from pitchlens.operators.ranked import ranked_points
from pitchlens.reports import coplay, overview, trainers
from pitchlens.schema import SCHEMAS
from pitchlens.skew import HotKeys, find_hot


def test_ranked_points_without_goals_are_zero(make_tables):
    tables = make_tables(match=[(1, day(0), 10, 20)], player=[(1, 1, 10), (2, 1, 20)])
    assert as_set(ranked_points(tables), "playerid", "ranked_off", "ranked_def") == {
        (1, 0.0, 0.0),
        (2, 0.0, 0.0),
    }


def test_ranked_points_merge_goals_of_one_minute(make_tables):
    # Two goals in minute 30 are one goal of twice the weight; the weakest defence is the baseline.
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (2, 1, 20)],
        goal=[(1, 10, 30, 1), (1, 10, 30, 1), (1, 10, 50, 1)],
    )
    # Defensive form of player 2: -3 / 90. Weights: minute 30 twice that, minute 50 once.
    got = {r.playerid: r for r in ranked_points(tables).collect()}
    form = -3 / 90
    assert abs(got[1].ranked_off - ((2 * form - 2 * form) + (form - 2 * form))) < 1e-12
    # Offensive form of player 1: 3 / 90, so weights 6 / 90 and 3 / 90; highest is 6 / 90.
    assert abs(got[2].ranked_def - (3 / 90 - 6 / 90)) < 1e-12
    assert got[1].ranked_def == 0.0 and got[2].ranked_off == 0.0


def test_match_points_count_matches_without_goals(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20), (2, day(1), 10, 20)],
        goal=[(1, 20, 5, None), (1, 20, 9, None), (2, 10, 3, None), (2, 20, 4, None)],
    )
    columns = ("matchid", "teamid", "score")
    points = trainers.match_points(tables.match, tables.goal, 2000, 2030)
    assert as_set(points, *columns) == {(1, 10, 0), (1, 20, 3), (2, 10, 1), (2, 20, 1)}
    compat = trainers.match_points(tables.match, tables.goal, 2000, 2030, compat=True)
    assert as_set(compat, *columns) == {(2, 10, 1), (2, 20, 1)}


def test_missing_referee_is_no_referee(spark, make_tables):
    tables = make_tables(match=[(1, day(0), 10, 20)])
    referee = spark.createDataFrame([(None, "nobody")], SCHEMAS["referee"])
    assert overview.top_referees(tables.match, referee).count() == 0


def test_positions(spark):
    profile = spark.createDataFrame(
        [(1, "a", None, "x", "Mittelstürmer"), (2, "b", None, "x", "Unbekannt")],
        SCHEMAS["profile"],
    )
    leaders = spark.createDataFrame([(1,), (2,)], "playerid bigint")
    assert as_set(overview.position_kind_counts(leaders, profile), "position_kind", "players") == {
        ("Mittelfeld", 1)
    }


def test_weighted_edges_are_the_edges_counted(spark, make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20), (2, day(1), 10, 20)],
        player=[(1, 1, 10), (2, 1, 10), (3, 1, 20), (1, 2, 10), (2, 2, 10), (4, 2, 10)],
        team=[(10, "A"), (20, "B")],
        profile=[(i, f"p{i}", None, "x", "y") for i in (1, 2, 3)],
    )
    present = coplay.coplay_presence(tables.player, tables.match, datetime.date(2018, 1, 1), ["F"])
    nodes = coplay.coplay_nodes(present, tables.profile, tables.team)
    assert as_set(nodes, "id", "teamname") == {(1, "A"), (2, "A"), (3, "B")}
    edges = sorted(tuple(r) for r in coplay.coplay_edges(present, nodes).collect())
    assert edges == [(1, 2), (1, 2), (2, 1), (2, 1)]
    weighted = coplay.coplay_edges_weighted(present, nodes)
    assert as_set(weighted, "source", "target", "weight") == {(1, 2, 2), (2, 1, 2)}


def test_later_scores_are_used_only_in_compat(spark, make_tables):
    tables = make_tables(match=[(1, day(5), 10, 20)], player=[(7, 1, 10)])
    lineups = features.lineups_since(tables.match, tables.player, 2000)
    scores = spark.createDataFrame(
        [(7, 1, 10, day(5), 1.0), (7, 2, 10, day(9), 2.0)],
        "playerid bigint, matchid bigint, teamid bigint, target_match_timestamp date, v double",
    )
    assert features.asof_scores(lineups, scores, ["v"]).count() == 0
    compat = features.asof_scores(lineups, scores, ["v"], compat=True)
    assert as_set(compat, "matchid", "score_day", "v") == {(1, day(9), 2.0)}


def test_errors_take_the_goals_as_truth(spark):
    rows = spark.createDataFrame([(0.0, 0.5), (2.0, 2.0), (4.0, 3.0)], "goals double, prediction double")
    got = training.model_errors(rows).first()
    assert abs(got.mae - 0.5) < 1e-12 and abs(got.mse - 1.25 / 3) < 1e-12
    assert abs(got.r2 - (1 - 1.25 / 8)) < 1e-12


def test_latest_other_match_in_one_pass_and_split(spark, make_tables):
    rng = random.Random(3)
    some = lambda *values: rng.choice(values)
    scores = {
        (some(1, 2, 3, None), rng.randrange(8), some(10, 20, None), some(day(3), day(4), day(9), None), rng.random())
        for _ in range(60)
    }
    scores = list({(p, m, t): row for row in scores for p, m, t in [row[:3]]}.values())
    lineups = [(m, t, p, day(5)) for m in range(9) for t in (10, 20, None) for p in (1, 2, 3, 4, None)]
    expected = set()
    for m, t, p, _ in lineups:
        own = [r for r in scores if r[0] == p and r[2] == t and None not in (p, t)]
        dated = [r for r in own if r[3]]
        other = {r[3] for r in dated if r[1] != m}
        latest = sorted({r[3] for r in dated})[-2:]
        days = [d for d in latest if d in other]
        if not own:
            expected.add((m, t, p, None, None))
        elif days:
            expected |= {(m, t, p, r[3], r[4]) for r in dated if r[3] == days[-1]}
    scores = spark.createDataFrame(
        scores, "playerid bigint, matchid bigint, teamid bigint, target_match_timestamp date, v double"
    )
    lineups = spark.createDataFrame(lineups, "matchid bigint, teamid bigint, playerid bigint, matchday date")
    for hot in (HotKeys(("playerid",)), find_hot(lineups, ["playerid"], 10)):
        got = features.asof_scores(lineups, scores, ["v"], compat=True, hot=hot)
        assert got.count() == len(expected)
        assert as_set(got, "matchid", "teamid", "playerid", "score_day", "v") == expected
