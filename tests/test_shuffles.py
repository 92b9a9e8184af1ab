"""How often rows are dealt out on the way to the points, and keys too large for that."""

import pytest
from conftest import FOLDER, as_set, day

from pitchlens import skew
from pitchlens.functions.columns import RANKED
from pitchlens.operators import neutral, ranked, rolling
from pitchlens.sources import adapter


@pytest.fixture
def no_shortcuts(spark):
    """Without broadcasts and adaptive plans, every exchange shows in the plan."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_line_items_are_dealt_out_once(spark, no_shortcuts):
    seen = adapter.appearances(spark, FOLDER, adapter.matches(spark, FOLDER))
    assert exchanges(seen) == 2  # the line items, and the matches


def test_goals_are_dealt_out_once(make_tables, no_shortcuts):
    tables = make_tables(match=[(1, day(1), 10, 20)], goal=[(1, 10, 5, 1)])
    assert exchanges(neutral.goals_per_match(tables)) == 1
    assert exchanges(neutral.match_facts(tables)) == 2


def test_orders_with_too_many_lines_give_the_same(spark, monkeypatch):
    columns = ["matchid", "playerid", "teamid", "qty", "disc", "tax", "rf", "ls"]
    match = adapter.matches(spark, FOLDER)
    want = as_set(adapter.appearances(spark, FOLDER, match), *columns)
    monkeypatch.setattr(skew, "FLOOR_ROWS", 3)
    assert as_set(adapter.appearances(spark, FOLDER, match), *columns) == want


def test_matches_with_too_many_goals_give_the_same(make_tables, monkeypatch):
    given = dict(
        match=[(m, day(m), 10, 20) for m in (1, 2)],
        player=[(1, 1, 10), (2, 1, 20), (1, 2, 10), (2, 2, 20)],
        goal=[(1, 10, 5 + k % 4, None if k % 2 else 1) for k in range(12)] + [(2, 20, 7, 2), (1, 20, None, 2)],
    )
    columns = ["playerid", "matchid", "teamid", "off", "def", "ranked_off", "ranked_def"]
    tables = make_tables(**given)
    assert tables.hot_matches.rows is None
    want = as_set(ranked.ranked_points(tables), *columns)
    assert ("off", 12.0) in {("off", r.off) for r in neutral.neutral_points(tables).collect()}
    monkeypatch.setattr(skew, "FLOOR_ROWS", 10)
    tables = make_tables(**given)
    # Line-ups, substitutions and cards alone are few.
    assert [r.matchid for r in tables.hot_matches.rows.collect()] == [1]
    assert as_set(ranked.ranked_points(tables), *columns) == want


def _both_ways(tables, monkeypatch):
    """``neutral_ranked_last_x`` with ``compat`` by windows alone, and by the join that hot players take."""
    stored = ranked.credited(tables, 2)
    windows = ranked.neutral_ranked_last_x(tables, (2,), stored=stored, compat=True)
    points = ranked.ranked_points(tables, 2, stored)
    keys = ["playerid", "matchid", "teamid", "saison", "tournament", "target_match_timestamp", "playtime_last_2"]
    career = rolling.last_x(points, (2,), keep=["saison", "tournament"], hot=tables.hot_players)
    season = rolling.last_x(
        points, (2,), (RANKED,), scope=("playerid", "saison"), keep=["tournament"], hot=tables.hot_players
    )
    return windows, career.join(season, keys)


def test_histories_with_equal_playtimes_need_one_shuffle(spark, make_tables, no_shortcuts, monkeypatch):
    lengths = {1: 90, 2: 120, 3: 90, 4: 90, 5: 100}
    matches = [(m, day(200 * m), 10, 20, lengths[m]) for m in lengths]
    tables = make_tables(
        # The second match is listed twice, with another length.
        match=[*matches, (2, day(400), 10, 20, 90)],
        player=[(p, m, 10 * p) for m in lengths for p in (1, 2)] + [(3, 3, None)],
        goal=[(m, 10 * (1 + m % 2), 9 * m, m % 2 + 1) for m in lengths],
    )
    windows, joined = _both_ways(tables, monkeypatch)
    assert exchanges(windows) == 1 < exchanges(joined)
    assert windows.columns == joined.columns
    told = [sorted(map(str, df.collect())) for df in (windows, joined)]
    assert told[0] == told[1] and len(told[0]) > len(set(told[0])) > 4
    assert len(told[0]) != 12  # not simply every row


def test_form_carries_only_the_ends_of_a_spell(make_tables):
    tables = make_tables(match=[(1, day(1), 10, 20)], player=[(1, 1, 10)], goal=[(1, 20, 5, 1)])
    row = ranked._form(tables, 1, lambda df, label: df).first()
    assert [s.asDict() for s in row.spells] == [{"in_time": 0, "out_time": 90}]
    assert (row.playtime, row["def"]) == (90, -1)
