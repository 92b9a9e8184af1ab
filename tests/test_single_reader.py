"""What a single query needs of the shared tables: seasons, X and days that it does not read are not made."""

from dataclasses import replace

import pytest
from conftest import FOLDER, day

from pitchlens import skew, staging
from pitchlens.functions.columns import total_col
from pitchlens.model import features
from pitchlens.operators import neutral, rolling, scores, segments
from pitchlens.plans import dataset, registry
from pitchlens.reports import careers
from pitchlens.sources.adapter import tables_from_orders


@pytest.fixture
def data(spark):
    """A data set of its own, so that nothing is stored yet."""
    return dataset.DataSet(tables_from_orders(spark, FOLDER), dataset.ORDERS_FEATURES_SINCE)


def rows(df, digits=9):
    columns = sorted(df.columns)
    told = [[round(v, digits) if isinstance(v, float) else v for v in r] for r in df.select(*columns).collect()]
    return sorted(map(str, told))


def both_ways(data, spark, query, shared):
    """The query's rows without the shared table, and with it; it must not have been stored by the first."""
    alone = rows(registry._QUERIES[query](data, spark, FOLDER))
    assert shared not in data.__dict__
    data._kept.pop("monthly", None)
    getattr(data, shared)
    return alone, rows(registry._QUERIES[query](data, spark, FOLDER))


def test_keys_do_not_travel_where_none_can_be_hot(spark):
    frame = spark.range(40).selectExpr("if(id < 20, 7L, id) as k", "id as v")
    before = len(staging._written)
    assert skew.find_hot(frame, ["k"], 40).rows is None
    assert len(staging._written) == before
    found = skew.find_hot(frame, ["k"], 6)
    assert [tuple(r) for r in found.rows.collect()] == [(7, 4)] and found.number == 1
    # Keys that share a hash value with others are hot only by themselves.
    few = pytest.MonkeyPatch()
    few.setattr(skew, "HASH_VALUES", 2)
    assert skew.find_hot(frame, ["k"], 6).rows.count() == 1
    assert skew.find_hot(frame.filter("v >= 20"), ["k"], 6).rows is None
    few.undo()


def test_the_last_match_alone_needs_no_history(spark, make_tables):
    tables = make_tables(
        match=[(m, day(m // 2), 10, 20) for m in range(1, 7)],
        player=[(p, m, 10 * p) for m in range(1, 7) for p in (1, 2)],
        goal=[(m, 10 * (1 + m % 2), 9 * m, 1) for m in range(1, 7)],
    )
    points = neutral.neutral_points(tables)
    one, both = (rolling.last_x(points, xs, hot=tables.hot_players) for xs in ((1,), (1, 2)))
    told = one._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("Window [") == 1 and "windowspecdefinition(playerid" in told
    assert rows(one) == rows(both.select(*one.columns))
    assert dict(one.dtypes) == dict(both.select(*one.columns).dtypes)


@pytest.mark.parametrize("query", ["worst5_avg_off", "topn_cumulative_avg_def", "filtered_count", "relevant_tournaments"])
def test_seasons_that_are_not_read_are_not_made(data, spark, query):
    alone, shared = both_ways(data, spark, query, "results")
    assert alone == shared and alone


def test_results_of_a_season_are_those_of_all(data):
    season = rows(data.results_of(["1998"]))
    assert season == rows(data.results.filter("saison = '1998'")) and season


@pytest.mark.parametrize("query", ["playtime_by_position", "top_playtime"])
def test_times_are_not_stored_for_one_reader(data, spark, query):
    alone, shared = both_ways(data, spark, query, "played")
    assert alone == shared and alone


def test_compared_players_need_one_x(data, spark):
    alone, shared = both_ways(data, spark, "team_minus_player", "scores")
    assert alone == shared and alone


def test_players_of_hot_matches_compare_the_same(data, monkeypatch):
    tables, aged = data.tables, data.aged_scores((1,))
    want = rows(careers.team_minus_player(aged, tables.profile, hot_matches=skew.HotKeys(("matchid",)), hot_players=tables.hot_players))
    hot = skew.find_hot(aged, ["matchid"], 2)
    assert hot.number > 1
    assert rows(careers.team_minus_player(aged, tables.profile, hot_matches=hot, hot_players=tables.hot_players)) == want


def test_segments_with_goals_are_told_once_per_player(make_tables):
    minutes = [None, -1, 0, 1, 5, 6, 10, 11, 64, 65, 66, 119, 120, 121, 200]
    tables = make_tables(
        match=[(m, day(m), 10, 20, 120) for m in range(len(minutes))],
        player=[(1, m, 10) for m in range(len(minutes))],
        goal=[(m, 20, t, named) for m, t in enumerate(minutes) for named in (None, None, 2)],
    )
    for compat in (False, True):
        found = segments.goalless_segments(tables, compat)
        got = sorted((r.matchid, r.segment_from) for r in found.collect())
        want = []
        for m, t in enumerate(minutes):
            for first in range(0, 120, 5):
                hit = t is not None and first < t <= first + 5
                want += [(m, first)] * (2 * compat if hit else 1)
        assert got == want
    plan = segments.goalless_segments(tables)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate explode(sequence")[0]
    assert above != plan and "lambda" not in above  # no function is called per segment


def test_only_two_days_of_scores_are_offered(data, monkeypatch):
    tables, keys = data.tables, ["teamid", "playerid"]
    table = data.scores_by_player((1,))
    lineups = features.lineups_since(tables.match, tables.player, 1996, tables.hot_matches)
    few = features._two_latest_days(table, keys)
    assert 0 < few.count() < table.count()
    assert few.groupBy(*keys).agg({"target_match_timestamp": "count"}).count() == table.select(*keys).distinct().count()
    attributes = ["playtime_last_1", total_col("off", 1)]
    usual = features.asof_scores(lineups, table, attributes, compat=True, hot=tables.hot_players)
    joined = features._latest_other_by_join(lineups.select("matchid", *keys), table, keys, attributes, tables.hot_players)
    assert rows(usual) == rows(joined) and usual.count() > 0


def test_players_with_several_profiles_keep_their_rows(data):
    twice = data.tables.profile.unionByName(data.tables.profile)
    data = dataset.DataSet(replace(data.tables, profile=twice), dataset.ORDERS_FEATURES_SINCE)
    alone = [rows(registry._asof(data, compat)) for compat in (False, True)]
    assert "scores" not in data.__dict__ and data.scores.count() > data.scores_by_player().count()
    assert alone == [rows(registry._asof(data, compat)) for compat in (False, True)]
    assert len(alone[1]) > len(set(alone[1]))


def test_scores_by_player_are_the_stored_ones(data):
    alone = data.scores_by_player()
    assert "scores" not in data.__dict__
    assert rows(alone) == rows(scores.score_with_age(data.tables).drop("age"))
