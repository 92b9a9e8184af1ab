"""The goal model: patience, prefixes of a fit, trees as a table, and the grid."""

import duckdb
import numpy as np
import pytest
from conftest import FOLDER
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pitchlens.model import training
from pitchlens.plans import dataset, registry
from pitchlens.staging import stage


@pytest.fixture(scope="module")
def prepared(spark):
    split = registry._stored_split(dataset.dataset_of(spark, FOLDER))
    return training.prepare(split)


def made(spark, rows):
    """Prepared rows from (goals, set, numbers)."""
    width = len(rows[0][2])
    names = [f"x{i}" for i in range(width)]
    flat = [(i, i % 7, float(g), s == "test", s == "valid", *map(float, x)) for i, (g, s, x) in enumerate(rows)]
    frame = spark.createDataFrame(
        flat, "matchid long, teamid long, goals double, is_test boolean, is_valid boolean, "
        + ", ".join(f"{n} double" for n in names)
    )
    steps = PipelineModel([VectorAssembler(inputCols=names, outputCol="features")])
    kept = ["matchid", "teamid", "goals", "is_test", "is_valid", "features"]
    return training.Prepared(stage(steps.transform(frame).select(*kept), "made"), steps, tuple(names), ())


def valid_error(prepared, trees):
    miss = trees.transform(prepared.part("valid")).agg(F.avg((F.col("prediction") - F.col("goals")) ** 2))
    return miss.first()[0]


def test_best_round():
    assert training.best_round([3.0, 2.0, 2.5, 2.4, 1.9, 2.0], 3) == (5, False)  # a late gain counts
    assert training.best_round([3.0, 2.0, 2.5, 2.4, 2.3, 1.9], 3) == (2, True)  # but not one after the patience
    assert training.best_round([3.0, 2.0, 2.5, 2.4, 2.3, 1.9], None) == (6, False)
    assert training.best_round([1.0, 1.0, 1.0], 2) == (1, True)
    assert training.best_round([5.0], 40) == (1, False)


def test_late_gain_is_found(spark):
    """The validation error rises at first, as the second effect is not in it; the third one helps."""
    rows = []
    for i in range(2000):
        x0, x1, x2 = i % 2, i // 2 % 2, i // 4 % 2
        rows.append((4 * x0 + 2 * x1 + x2, "train", (x0, x1, x2)))
        if i % 5 == 0:
            rows.append((4 * x0 - 0.3 * x1 + 5 * x2, "valid", (x0, x1, x2)))
    data = made(spark, rows)
    boosted = training.boost(data, 60, 0.3, depth=1, patience=12)
    curve = np.array(boosted.curve)
    rise = int(np.argmax(np.diff(curve) > 0))  # Spark's own stop would end at this round
    assert boosted.best() > rise + 1 and curve[boosted.best() - 1] < curve[: rise + 1].min()


def test_more_trees_are_fitted_until_the_patience_ends(prepared):
    short = training.boost(prepared, 40, 0.1, patience=2)
    best, ended = training.best_round(short.curve, 2)
    assert ended or len(short.curve) == 40
    assert len(short.curve) in (7, 14, 28, 40) and short.best() == best
    whole = training.boost(prepared, len(short.curve) + 3, 0.1, patience=None)
    assert len(whole.curve) == whole.best() == whole.trees.getNumTrees
    prefix = training.first_trees(whole.trees, best)
    assert prefix.getNumTrees == best and prefix.numFeatures == len(prepared.inputs)
    assert valid_error(prepared, prefix) == pytest.approx(short.curve[best - 1], rel=1e-6)


def test_without_validation_rows_all_trees_are_kept(spark):
    data = made(spark, [(i % 3, "train", (i % 3, i % 5)) for i in range(60)])
    boosted = training.boost(data, 6, 0.5, patience=2)
    assert boosted.best() == boosted.trees.getNumTrees == 6


WALK = """
WITH RECURSIVE walk AS (
  SELECT matchid, teamid, x, tree, 0 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT matchid, teamid, x, walk.tree, CASE WHEN x[feature + 1] <= threshold THEN n.left ELSE n.right END
  FROM walk JOIN nodes n ON n.tree = walk.tree AND n.node = walk.node WHERE n.feature IS NOT NULL
)
SELECT matchid, teamid, sum(weight * value) AS prediction
FROM walk JOIN nodes n ON n.tree = walk.tree AND n.node = walk.node WHERE n.feature IS NULL GROUP BY ALL
"""


def test_node_table_predicts_like_the_model(spark, prepared, tmp_path):
    boosted = training.boost(prepared, 12, 0.3, depth=3, patience=None)
    trees = training.first_trees(boosted.trees, 9)
    nodes = training.tree_nodes(trees, spark)
    assert nodes.select("tree").distinct().count() == 9
    test = prepared.part("test")
    want = {(r.matchid, r.teamid): r.prediction for r in trees.transform(test).collect()}
    joined = training.score_by_nodes(test, nodes, depth=3).collect()
    assert {(r.matchid, r.teamid): pytest.approx(r.prediction, rel=1e-9) for r in joined} == want
    con = duckdb.connect()
    con.register("nodes", nodes.toArrow())
    con.register("rows", test.select("matchid", "teamid", training.vector_to_array("features").alias("x")).toArrow())
    told = {(m, t): pytest.approx(p, rel=1e-9) for m, t, p in con.execute(WALK).fetchall()}
    assert told == want


def test_grid_uses_the_best_prefix_of_each_rate(spark, prepared):
    rates, counts = (0.2, 0.7), (2, 5, 30)
    fits = training.boost_each(prepared, rates, max(counts), patience=6, parallel=2)
    assert set(fits) == set(rates)
    grid = {(r.rate, r.n_trees): r for r in training.model_grid(prepared, fits, counts).collect()}
    assert len(grid) == 6
    for (rate, n), row in grid.items():
        curve = fits[rate].curve
        assert row.trees_used <= n and row.trees_used == training.best_round(curve[:n], 6)[0]
        assert row.valid_mse == curve[row.trees_used - 1]
        trees = training.first_trees(fits[rate].trees, row.trees_used)
        rows = trees.transform(prepared.part("test")).select("goals", F.round("prediction").alias("p")).toPandas()
        assert row.mae == pytest.approx((rows.p - rows.goals).abs().mean())
        assert row.mse == pytest.approx(((rows.p - rows.goals) ** 2).mean())
    curves = training.model_curves(fits, spark).toPandas()
    assert (curves.groupby("rate").is_best.sum() == 1).all()
    assert len(curves) == sum(len(f.curve) for f in fits.values())


def test_a_failing_fit_ends_the_others(prepared):
    with pytest.raises(Exception):
        training.boost_each(prepared, (0.1, -1.0), 400, patience=None, parallel=2)
