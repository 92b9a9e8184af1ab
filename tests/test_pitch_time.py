from conftest import as_set, day

from pitchlens.operators.neutral import neutral_points, neutral_points_compat
from pitchlens.operators.pitch_time import player_time, playtime_by_season, presence_of
from pitchlens.operators.ranked import ranked_points
from pitchlens.operators.scores import score_set
from pitchlens.operators.segments import goalless_segments

TIMES = ("playerid", "in_time", "out_time", "playtime")


def test_stays_comes_on_and_goes_off(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (2, 1, 10)],
        substitution=[(1, 10, 3, 1, 60)],
    )
    assert as_set(player_time(tables), *TIMES) == {(1, 0, 60, 60), (2, 0, 90, 90), (3, 60, 90, 30)}


def test_equal_ends_and_unknown_length_count_one_minute(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20), (2, day(0), 10, 20, None)],
        player=[(1, 1, 10), (2, 2, 10)],
        substitution=[(1, 10, 3, 1, 90)],
    )
    assert as_set(player_time(tables), *TIMES) == {
        (1, 0, 90, 90),
        (3, 90, 90, 1),
        (2, 0, None, 1),
    }


def test_unknown_minute_means_not_substituted(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10)],
        substitution=[(1, 10, 3, 1, None)],
    )
    assert as_set(player_time(tables), *TIMES) == {(1, 0, 90, 90), (3, None, 90, 1)}


def test_dismissals(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (2, 1, 10), (4, 1, 10), (5, 1, 10)],
        substitution=[(1, 10, 3, 1, 60)],
        card=[
            (1, 10, 1, "red", 70),
            (1, 10, 2, "yellowred", 80),
            (1, 10, 2, "red", 81),
            (1, 10, 4, "yellow", 30),
            (1, 10, 5, "red", None),
        ],
    )
    assert as_set(player_time(tables), *TIMES) == {
        (1, 0, 60, 60),
        (2, 0, 80, 80),
        (3, 60, 90, 30),
        (4, 0, 90, 90),
        (5, 0, None, 1),
    }


def test_copies_and_missing_keys(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (1, 1, 10), (None, 1, 10), (2, 9, 10)],
        substitution=[(1, 10, 3, 1, 60), (1, 10, 3, 1, 60), (1, 10, 4, None, 50)],
        card=[(1, 10, None, "red", 20)],
    )
    assert as_set(player_time(tables), *TIMES) == {
        (1, 0, 60, 60),
        (3, 60, 90, 30),
        (4, 50, 90, 40),
        (None, 0, 90, 90),
    }


def test_several_spells(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10)],
        substitution=[(1, 10, 1, 7, 70), (1, 10, 7, 1, 60)],
        goal=[(1, 20, 65, None), (1, 20, 30, None)],
    )
    spells = as_set(player_time(tables).filter("playerid = 1"), *TIMES)
    assert spells == {(1, 0, 60, 60), (1, 70, 60, -10)}
    assert presence_of(player_time(tables)).count() == 2
    points = neutral_points(tables).filter("playerid = 1")
    assert as_set(points, "playtime", "off", "def") == {(50, 0.0, -1)}


def test_goal_at_the_minute_of_a_substitution_counts_for_both(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (5, 1, 20)],
        substitution=[(1, 10, 3, 1, 60)],
        goal=[(1, 10, 60, 1)],
    )
    assert as_set(neutral_points(tables), "playerid", "off", "def", "diff") == {
        (1, 1.0, 0, 1.0),
        (3, 1.0, 0, 1.0),
        (5, 0.0, -1, -1.0),
    }


def test_compat_drops_players_who_conceded_nothing(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (5, 1, 20)],
        goal=[(1, 10, 60, 1), (1, 10, 60, 1)],
    )
    assert as_set(neutral_points(tables), "playerid", "def") == {(1, 0), (5, -2)}
    assert as_set(neutral_points_compat(tables), "playerid", "def") == {(5, -2)}


def test_player_listed_for_two_teams_is_kept_apart(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10), (1, 1, 20)],
        goal=[(1, 10, 60, 1)],
    )
    assert as_set(neutral_points(tables), "teamid", "off", "def") == {(10, 1.0, 0), (20, 0.0, -1)}


def test_playtime_by_season(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20), (2, day(5), 10, 20), (3, day(400), 10, 20)],
        player=[(1, 1, 10), (1, 2, 10), (1, 3, 10)],
    )
    assert as_set(playtime_by_season(tables), "playerid", "saison", "playtimes") == {
        (1, "2018", 180),
        (1, "2019", 90),
    }


def test_goalless_segments(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20, 22)],
        player=[(1, 1, 10), (2, 1, 99)],
        goal=[(1, 20, 5, 8), (1, 20, 6, None), (1, 20, 6, None), (1, 10, 12, 1)],
    )
    columns = ("playerid", "segment_from", "segment_to")
    assert as_set(goalless_segments(tables), *columns) == {(1, 10, 15), (1, 15, 20)}
    rows = sorted(tuple(r) for r in goalless_segments(tables, True).select(*columns).collect())
    assert rows == [(1, 5, 10), (1, 5, 10), (1, 10, 15), (1, 15, 20)]


def test_unknown_players_have_times_but_no_points(make_tables):
    tables = make_tables(
        match=[(1, day(0), 10, 20), (2, day(1), 30, 40)],
        player=[(None, 1, 10), (None, 2, 30), (5, 1, 10), (5, 2, 30)],
        goal=[(1, 10, 5, None), (2, 30, 9, None)],
    )
    assert player_time(tables).filter("playerid is null").count() == 2
    for rows in (neutral_points(tables), score_set(tables), ranked_points(tables)):
        assert rows.filter("playerid is null").count() == 0 and rows.count() == 2
