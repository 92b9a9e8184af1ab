"""The goal model: split, impute, gradient-boosted trees, errors, and a grid of settings.

Trees are added until the error on the validation rows has not fallen for some rounds (the patience),
and those after the best round are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.model.features import ATTRIBUTES
from pitchlens.staging import new_path, stage

SEED = 123
#: Rounds without a smaller error on the validation rows after which no more trees are added.
PATIENCE = 40
TEST_PERCENT = VALID_PERCENT = 10
LABEL = "goals"
BASE_INPUTS = (
    "saison",
    "is_home",
    "matchlength",
    "playtime",
    "opponent_playtime",
    "year",
    "month",
    "day",
)


def inputs_of(attributes: Sequence[str] = ATTRIBUTES) -> list[str]:
    """The model's inputs: the base ones, and the attributes of both sides."""
    return [*BASE_INPUTS, *attributes, *[f"opponent_{a}" for a in attributes]]


def train_split(
    features: DataFrame,
    seed: int = SEED,
    test: int = TEST_PERCENT,
    valid: int = VALID_PERCENT,
    compat: bool = False,
) -> DataFrame:
    """Add ``is_test`` and ``is_valid``, true for about ``test`` and ``valid`` percent of the rows.

    Both sides of a match fall into the same set, since each row holds the other's strength. They
    depend on ids only, so they come out the same however the data is partitioned or a task is
    repeated. With ``compat`` sides are dealt out singly, and the test rows also validate.
    """
    mixed = F.col("matchid") % 1000003 * 7919
    if compat:
        mixed = (mixed + F.col("teamid") % 1009 * 104729 + seed) % 1000
        return features.withColumns({"is_test": mixed < test * 10, "is_valid": mixed < test * 10})
    mixed = (mixed + seed) % 1000
    is_valid = (mixed >= test * 10) & (mixed < (test + valid) * 10)
    return features.withColumns({"is_test": mixed < test * 10, "is_valid": is_valid})


def staged(split: DataFrame) -> DataFrame:
    """Training reads the rows many times, so they are stored first."""
    return stage(split, "split")


def _prepared(split: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Inputs as doubles. Of a season such as 1998/99 the first year counts."""
    text = {"saison": F.regexp_extract(F.col("saison").cast("string"), r"\d{4}", 0)}
    doubles = [text.get(c, F.col(c)).try_cast("double").alias(c) for c in inputs]
    return split.select(
        "matchid", "teamid", F.col(LABEL).cast("double").alias(LABEL), "is_test", "is_valid", *doubles
    )


@dataclass(frozen=True)
class Prepared:
    """Rows with their inputs imputed and assembled, stored, and the steps that did so.

    ``rows`` has the ids, the goals, ``is_test``, ``is_valid`` and the vector ``features``; the n-th
    number of the vector is ``inputs[n]``.
    """

    rows: DataFrame
    steps: PipelineModel
    inputs: tuple[str, ...]
    attributes: tuple[str, ...]

    def part(self, name: str) -> DataFrame:
        """The rows for ``train``, ``valid`` or ``test``."""
        conditions = {"train": "not is_test and not is_valid", "valid": "is_valid", "test": "is_test"}
        return self.rows.filter(conditions[name])


def imputer(split: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> tuple[PipelineModel, list[str]]:
    """The step that fills missing inputs with the means of the training rows, and its inputs.

    Inputs without any value in the training rows are left out.
    """
    inputs = inputs_of(attributes)
    training = _prepared(split, inputs).filter("not is_test and not is_valid")
    known = training.agg(*[F.count(c).alias(c) for c in inputs]).first()
    inputs = [c for c in inputs if known[c]]
    return Imputer(strategy="mean", inputCols=inputs, outputCols=[f"_{c}" for c in inputs]).fit(training), inputs


def imputed(split: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Ids, set and goals of every row with its inputs, missing ones filled in."""
    filler, inputs = imputer(split, attributes)
    rows = filler.transform(_prepared(split, inputs_of(attributes)))
    return rows.select("matchid", "teamid", LABEL, "is_test", "is_valid", *[F.col(f"_{c}").alias(c) for c in inputs])


def prepare(split: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> Prepared:
    """Impute and assemble once, for any number of fits."""
    filler, inputs = imputer(split, attributes)
    assembler = VectorAssembler(inputCols=[f"_{c}" for c in inputs], outputCol="features")
    steps = PipelineModel([filler, assembler])
    rows = steps.transform(_prepared(split, inputs_of(attributes)))
    rows = stage(rows.select("matchid", "teamid", LABEL, "is_test", "is_valid", "features"), "goal-inputs")
    return Prepared(rows, steps, tuple(inputs), tuple(attributes))


def best_round(curve: Sequence[float], patience: int | None = PATIENCE) -> tuple[int, bool]:
    """The number of trees with the smallest error, and whether the patience ended before the curve.

    Rounds after the patience has ended do not count, even if they are better.
    """
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif patience is not None and i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(trees: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The model of the first ``count`` trees: boosting only ever adds to what there is."""
    java, gateway = trees._java_obj, SparkSession.active().sparkContext._gateway
    count = min(count, trees.getNumTrees)
    kinds = gateway.jvm.org.apache.spark.ml.regression
    parts = gateway.new_array(kinds.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i, (part, weight) in enumerate(zip(java.trees()[:count], trees.treeWeights)):
        parts[i], weights[i] = part, weight
    return GBTRegressionModel(kinds.GBTRegressionModel(java.uid(), parts, weights, trees.numFeatures))


@dataclass(frozen=True)
class Boosted:
    """Fitted trees, and the mean squared error on the validation rows after 1, 2, ... of them."""

    trees: GBTRegressionModel
    curve: tuple[float, ...]
    patience: int | None

    def best(self, most: int | None = None) -> int:
        """How many trees a model has that may use ``most``."""
        return best_round(self.curve[:most], self.patience)[0]


def boost(
    prepared: Prepared,
    n_trees: int = 500,
    rate: float = 0.1,
    depth: int = 4,
    patience: int | None = PATIENCE,
) -> Boosted:
    """Add trees until the patience ends, ``n_trees`` at most.

    Spark's own early stop gives up at the first round that does not gain enough, so trees are fitted
    without it, and the error of every prefix is read off afterwards, in one pass. The number
    doubles until the curve shows that the patience has ended; the trees of a shorter fit are the
    beginning of a longer one, so at most half of the work is repeated. Without validation rows, or
    with ``patience`` None, all trees are kept.
    """
    training, valid = prepared.part("train"), prepared.part("valid")
    if valid.isEmpty():
        patience = None
    size = n_trees if patience is None else min(n_trees, patience * 3 // 2 + 4)
    while True:
        trees = GBTRegressor(labelCol=LABEL, maxIter=size, stepSize=rate, maxDepth=depth, seed=SEED).fit(training)
        if patience is None:
            return Boosted(trees, tuple(float(size - i) for i in range(size)), None)
        curve = tuple(trees.evaluateEachIteration(valid, "squared"))
        if best_round(curve, patience)[1] or size >= n_trees:
            return Boosted(trees, curve, patience)
        size = min(n_trees, 2 * size)


@dataclass(frozen=True)
class GoalModel:
    """Steps from rows to a prediction, with the best number of trees; the curve they come from."""

    pipeline: PipelineModel
    curve: tuple[float, ...]
    inputs: tuple[str, ...]
    attributes: tuple[str, ...]

    @property
    def trees(self) -> GBTRegressionModel:
        return self.pipeline.stages[-1]


def goal_model(
    split: DataFrame,
    n_trees: int = 500,
    rate: float = 0.1,
    depth: int = 4,
    patience: int | None = PATIENCE,
    attributes: Sequence[str] = ATTRIBUTES,
) -> GoalModel:
    """Fit on the training rows, with as many trees as are best on the validation rows.

    Test rows are seen by neither. The means for missing values come from the training rows alone;
    inputs that have no value there are left out. Features are binned and trees grown by Spark ML,
    level by level over all partitions.
    """
    prepared = prepare(split, attributes)
    boosted = boost(prepared, n_trees, rate, depth, patience)
    trees = first_trees(boosted.trees, boosted.best())
    return GoalModel(
        PipelineModel([*prepared.steps.stages, trees]), boosted.curve, prepared.inputs, prepared.attributes
    )


def tree_nodes(model: GBTRegressionModel, spark: SparkSession) -> DataFrame:
    """The trees as a table, a row per node.

    ``tree`` and ``weight``; ``node`` (0 is the root); where a node splits, ``feature`` (its place among the
    inputs), ``threshold``, ``left`` (for values up to it) and ``right``; ``value``, what a leaf predicts. Written
    by Spark, so no node passes the driver.
    """
    path = new_path(spark, "goal-trees")
    model.write().save(path)
    weights = spark.createDataFrame(list(enumerate(model.treeWeights)), "tree int, weight double")
    node = F.col("nodeData")
    split = node["leftChild"] >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(split, node["split"]["featureIndex"]).alias("feature"),
        F.when(split, F.element_at(node["split"]["leftCategoriesOrThreshold"], 1)).alias("threshold"),
        F.when(split, node["leftChild"]).alias("left"),
        F.when(split, node["rightChild"]).alias("right"),
        node["prediction"].alias("value"),
    )
    return nodes.join(F.broadcast(weights), "tree")


def score_by_nodes(rows: DataFrame, nodes: DataFrame, depth: int, keys: Sequence[str] = ("matchid", "teamid")) -> DataFrame:
    """Predictions from the node table alone: joins that walk down one level at a time.

    ``rows`` has ``keys`` and the vector ``features``; returns the keys and ``prediction``. For checks and for
    engines without the model: a row walks through every tree, so ``transform`` of the model is faster.
    """
    nodes = stage(nodes, "goal-nodes")
    number = nodes.agg(F.coalesce(F.max("tree"), F.lit(-1)) + 1).first()[0]
    walk = rows.select(*keys, vector_to_array("features").alias("x"))
    walk = walk.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("node", F.lit(0))
    for _ in range(depth):
        below = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        step = nodes.select("tree", "node", "feature", "threshold", "left", "right")
        walk = walk.join(step, ["tree", "node"]).withColumn("node", F.coalesce(below, F.col("node")))
        walk = walk.select(*keys, "x", "tree", "node")
    leaves = walk.join(nodes.select("tree", "node", "weight", "value"), ["tree", "node"])
    return leaves.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("prediction"))


def goal_predictions(model: GoalModel, split: DataFrame) -> DataFrame:
    """Predictions for the test rows, plain and rounded."""
    rows = _prepared(split, inputs_of(model.attributes)).filter("is_test")
    return _rounded(model.pipeline.transform(rows))


def _rounded(predicted: DataFrame) -> DataFrame:
    return predicted.select(
        "matchid",
        "teamid",
        LABEL,
        "prediction",
        F.round("prediction", 0).alias("prediction_rounded"),
    )


def mean_predictions(split: DataFrame) -> DataFrame:
    """The mean goals of the training rows as prediction for every test row: what a model has to beat."""
    rows = _prepared(split, [])
    mean = rows.filter("not is_test and not is_valid").agg(F.avg(LABEL)).first()[0]
    return _rounded(rows.filter("is_test").withColumn("prediction", F.lit(mean).cast("double")))


def model_errors(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row with mae, mse and r2, the goals being the truth."""
    miss = F.col(prediction) - F.col(LABEL)
    spread = F.var_pop(LABEL)
    mse = F.avg(miss * miss)
    return predictions.agg(
        F.avg(F.abs(miss)).alias("mae"),
        mse.alias("mse"),
        (1 - F.try_divide(mse, spread)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


#: Learning rates and numbers of trees of the grid.
RATES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
TREES = (100, 500, 1000, 5000)


def boost_each(
    prepared: Prepared,
    rates: Sequence[float] = RATES,
    n_trees: int = max(TREES),
    depth: int = 4,
    patience: int | None = PATIENCE,
    parallel: int = 8,
) -> dict[float, Boosted]:
    """One fit per rate over the same stored rows, ``parallel`` at a time, each a job group of its own.

    A fit is a long chain of short jobs that waits for its driver between them; several chains keep
    the executors busy. If one fails, the jobs of the others are cancelled.
    """
    spark = prepared.rows.sparkSession
    context = spark.sparkContext

    @inheritable_thread_target(spark)
    def fit(rate: float) -> Boosted:
        context.setJobGroup(f"goal-model-{rate}", f"goal model with learning rate {rate}", True)
        return boost(prepared, n_trees, rate, depth, patience)

    with ThreadPoolExecutor(max(1, min(parallel, len(rates)))) as pool:
        jobs = {rate: pool.submit(fit, rate) for rate in rates}
        try:
            return {rate: job.result() for rate, job in jobs.items()}
        except BaseException:
            for rate, job in jobs.items():
                job.cancel()
                context.cancelJobGroup(f"goal-model-{rate}")
            raise


def model_curves(fits: dict[float, Boosted], spark: SparkSession) -> DataFrame:
    """A row per rate and number of trees: the error on the validation rows, and whether it is the best."""
    rows = [
        (rate, i + 1, error, i + 1 == boosted.best())
        for rate, boosted in fits.items()
        for i, error in enumerate(boosted.curve)
    ]
    return spark.createDataFrame(rows, "rate double, n_trees int, valid_mse double, is_best boolean")


def model_grid(
    prepared: Prepared, fits: dict[float, Boosted], trees: Sequence[int] = TREES
) -> DataFrame:
    """Errors of rounded predictions on the test rows for every number of trees and learning rate.

    A model of fewer trees is the beginning of one with more, so each rate needs one fit only: a number
    of trees uses the best prefix within it (``trees_used``). ``valid_mse`` is the error that chose it.
    """
    test = prepared.part("test")
    errors: dict[tuple[float, int], DataFrame] = {}
    for rate, boosted in fits.items():
        for used in sorted({boosted.best(n) for n in trees}):
            predicted = _rounded(first_trees(boosted.trees, used).transform(test))
            errors[rate, used] = model_errors(predicted, "prediction_rounded").first()
    rows = []
    for rate, boosted in fits.items():
        for n in sorted(trees):
            used = boosted.best(n)
            found = errors[rate, used]
            rows.append((int(n), float(rate), used, boosted.curve[used - 1], found.mae, found.mse, found.r2))
    return prepared.rows.sparkSession.createDataFrame(
        rows, "n_trees int, rate double, trees_used int, valid_mse double, mae double, mse double, r2 double"
    )
