"""Tables stored by key: no exchange where they are read by it, and the same rows."""

import pytest
from conftest import FOLDER, day

from pitchlens import layout, skew
from pitchlens.operators import neutral, pitch_time, ranked, rolling
from pitchlens.plans import dataset
from pitchlens.staging import new_path, stage


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


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_no_exchange_by_match_or_player(spark, no_shortcuts):
    tables = dataset.dataset_of(spark, FOLDER).tables
    laid = layout.lay_out(tables)
    assert exchanges(neutral.neutral_points(tables)) > 0
    assert exchanges(neutral.neutral_points(laid.tables)) == 0
    assert exchanges(pitch_time.player_time(laid.tables)) == 0
    by_match = lambda df, label: layout.stage_by_key(df, label, ["matchid"], laid.buckets)
    assert exchanges(ranked._goal_weights(ranked._form(laid.tables, 1, by_match), laid.tables)) <= 1  # by minute of a match
    assert exchanges(laid.last_x((1, 5))) == 0
    assert exchanges(rolling.last_x(laid.points, (2,), scope=("playerid", "saison"))) == 0
    assert exchanges(laid.ranked_points()) == 0
    assert exchanges(laid.points.groupBy("playerid", "teamid").count()) == 0


def test_layout_changes_no_rows(spark):
    tables = dataset.dataset_of(spark, FOLDER).tables
    laid = layout.lay_out(tables, buckets=8)
    assert laid.buckets == 8 and rows(laid.points) == rows(neutral.neutral_points(tables))
    assert rows(pitch_time.player_time(laid.tables)) == rows(pitch_time.player_time(tables))


def test_hot_keys_get_no_layout(make_tables, monkeypatch):
    tables = make_tables(
        match=[(m, day(m), 10, 20) for m in range(1, 9)],
        player=[(1, m, 10) for m in range(1, 9)] + [(2, 1, 20)],
        goal=[(m, 10, 5 * m, 1) for m in range(1, 9)],
    )
    want = rows(rolling.last_x(neutral.neutral_points(tables), (3,)))
    monkeypatch.setattr(skew, "FLOOR_ROWS", 3)
    laid = layout.lay_out(tables)
    assert laid.tables.hot_players.rows is not None and laid.tables.hot_matches.rows is None
    assert "Bucketed: true" not in laid.points._jdf.queryExecution().executedPlan().toString()
    assert rows(laid.last_x((3,))) == want


def test_a_layout_is_opened_by_another_application(spark, no_shortcuts):
    points = spark.range(1000).selectExpr("id % 37 AS playerid", "id AS matchid")
    path = new_path(spark, "kept")
    stored = layout.write_by_key(points, "kept_points", path, ["playerid"], 4)
    want = rows(stored)
    spark.sql("DROP TABLE kept_points")  # the table is external: the files stay
    opened = layout.open_by_key(spark, "kept_points", path, ["playerid"], 4)
    assert rows(opened) == want == rows(points)
    assert exchanges(opened.groupBy("playerid").count()) == 0
    assert rows(layout.open_by_key(spark, "kept_points", path, ["playerid"], 4)) == want
    spark.sql("DROP TABLE kept_points")


def test_buckets():
    assert [layout.buckets_for(n, 8) for n in (0, 1, 16_000_000, 17_000_000)] == [8, 8, 8, 16]
    assert layout.buckets_for(0, 12) == 16


def test_times_and_weights_are_stored_in_as_few_shuffles_as_can_be(spark, no_shortcuts, monkeypatch):
    tables = dataset.dataset_of(spark, FOLDER).tables
    by_key, plain = [], []

    def dealt(df, label, keys, buckets, is_dealt=False):
        by_key.append((label, exchanges(df), is_dealt))
        return real(df, label, keys, buckets, is_dealt)

    real = layout.stage_by_key
    monkeypatch.setattr(layout, "stage_by_key", dealt)
    monkeypatch.setattr(layout, "stage", lambda df, label: plain.append(label) or stage(df, label))
    laid = layout.lay_out(tables, buckets=8)
    found = rows(laid.ranked_points())
    assert [label for label, *_ in by_key] == ["by-match-match", "by-match-goal", "by-match-entries", "form", "ranked-1"]
    assert ("by-match-entries", 1, True) in by_key and plain == ["credited"]
    assert found == rows(ranked.ranked_points(tables).select(*laid.ranked_points().columns))
    files = laid.tables.stored_entries.inputFiles()
    assert 0 < len(files) <= 8
