"""Attributes as vectors give what attributes as columns give."""

import datetime

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from pitchlens.functions.columns import WIDE_ATTRIBUTES
from pitchlens.model import features as feat
from pitchlens.model import training
from pitchlens.plans import dataset, registry

NAMES = ["a", "b", "c"]


def rows(df):
    order = sorted(df.columns)
    return sorted((tuple(repr(r[c]) if not isinstance(r[c], float) else repr(round(r[c], 9)) for c in order) for r in df.collect()))


@pytest.fixture
def known(spark):
    rng = np.random.default_rng(4)
    out = []
    for m in range(12):
        for team in (1, 2, 3)[: 1 + m % 3]:
            for p in range(5):
                values = [None if rng.random() < (0.95 if m in (4, 6) else 0.2) else float(rng.normal()) for _ in NAMES]
                out.append((m, team, 10 * team + p, *values))
    return spark.createDataFrame(out, "matchid long, teamid long, playerid long, a double, b double, c double")


@pytest.fixture
def times(spark):
    told = [(10 * t + p, m, t, None if p == 4 and m == 2 else 5 * p) for m in range(12) for t in (1, 2, 3) for p in range(5) if (m + p) % 4]
    return spark.createDataFrame(told + told[:9], "playerid long, matchid long, teamid long, playtime int")


def as_vectors(known):
    return known.select("matchid", "teamid", "playerid", F.array(*NAMES).alias(feat.VECTOR))


def test_team_vectors_equal_team_strength(known, times):
    want = feat.team_strength(known, times, NAMES)
    got = feat.named(feat.team_vectors(as_vectors(known), times), NAMES)
    assert want.filter("a is null or b is null or c is null").count() > 0
    assert rows(got) == rows(want.select(*got.columns))


def test_match_vectors_equal_match_features(spark, known, times):
    day = datetime.date(2018, 3, 1)
    goals = spark.createDataFrame(
        [(m, day, "2018", 90 + m, team, other, team == 1, m % 4) for m in range(12) for team, other in ((1, 2), (2, 1))],
        "matchid long, matchday date, saison string, matchlength int, teamid long, opponent long, is_home boolean, goals long",
    )
    strength = feat.team_strength(known, times, NAMES)
    vectors = feat.team_vectors(as_vectors(known), times)
    want = feat.match_features(goals, strength)
    got = feat.match_vectors(goals, vectors)
    assert rows(feat.named(got, NAMES)) == rows(want) and want.count() == 16
    want = feat.match_features_norm(want, NAMES, keep_ids=True)
    got = feat.named(feat.match_vectors_norm(got), NAMES)
    assert rows(got) == rows(want) and 0 < want.count() < 16


def test_wide_attributes_train_a_model(spark):
    data = dataset.dataset_of(spark, FOLDER)
    wide = feat.named(registry._wide_features(data), WIDE_ATTRIBUTES)
    assert len(WIDE_ATTRIBUTES) == 81
    prepared = training.prepare(training.train_split(wide), WIDE_ATTRIBUTES)
    assert len(prepared.inputs) >= 2 * 81
    assert training.boost(prepared, 3, 0.3, patience=None).trees.getNumTrees == 3
