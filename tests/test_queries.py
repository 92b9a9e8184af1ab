"""Every query against its SQL, and once more with nearly every key treated as hot."""

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.oracle import oracle_sql
from checks.verify import compare, connect
from pitchlens import skew
from pitchlens.model import training
from pitchlens.plans import dataset, registry
from pitchlens.sources import tables_from_orders

ORACLES, QUERIES = oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_but_the_trained_ones_has_sql():
    without = set(QUERIES) - set(ORACLES)
    assert without == {"goal_predictions", "model_errors", "model_grid", "goal_trees", "model_curves"}
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    outcome = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


SPLIT = [
    "player_time",
    "neutral_points",
    "goalless_segments",
    "score_set",
    "score_with_age",
    "ranked_points",
    "neutral_ranked_last_x",
    "career_curve",
    "team_minus_player",
    "team_minus_player_curve",
    "coplay_edges",
    "coplay_edges_weighted",
    "asof_scores",
    "asof_scores_compat",
    "team_strength",
    "trainer_effect",
    "coplay_nodes",
]


@pytest.fixture(scope="module")
def hot_data(spark):
    floor, skew.FLOOR_ROWS = skew.FLOOR_ROWS, 3
    data = dataset.DataSet(
        tables_from_orders(spark, FOLDER), dataset.ORDERS_FEATURES_SINCE
    )
    assert data.tables.hot_players.rows is not None
    assert data.tables.hot_matches.rows is not None
    assert data.tables.hot_teams.rows is not None
    yield data
    skew.FLOOR_ROWS = floor


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys_equals_sql(spark, con, hot_data, name):
    def query(session, folder):
        df = registry._QUERIES[name](hot_data, session, folder)
        return registry.comparable(df, registry.DIGITS.get(name, 6))

    outcome = compare(spark, con, FOLDER, name, query, ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_model_learns_something(spark):
    errors = entry.queries()["model_errors"](spark, FOLDER).first()
    assert errors.n > 0 and 0 <= errors.mae < 2


def test_model_takes_seasons_that_are_no_numbers(spark):
    split = training.staged(registry._split(dataset.dataset_of(spark, FOLDER)))
    for season in (F.concat(F.col("saison"), F.lit("/99")), F.lit("none")):
        model = training.goal_model(split.withColumn("saison", season), n_trees=2)
        assert model.trees.getNumTrees <= 2 and training.goal_predictions(model, split).count() > 0
    assert split.groupBy("matchid").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count() == 0
    assert split.filter("is_test and is_valid").count() == 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert {"playerid", "matchid", "playtime_last_5", "avg_diff_last_1", "age"} <= set(df.columns)
    assert df.count() > 0
