"""Splits, forest, boosted trees, persistence and the full ensemble."""

import json
import os
import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, ModelSettings
from trafficlens.operators import boosting, evaluation, models
from trafficlens.operators.features import FEATURE_NAMES, session_features
from trafficlens.operators.skew import materialize, new_path
from trafficlens.plans import scoring, store
from trafficlens.sources.requests import read_events, requests_from_events

QUICK = replace(DEFAULT, models=ModelSettings(boost_trees=8))


@pytest.fixture(scope="module")
def features(spark):
    rows = requests_from_events(read_events(spark, "/root/testdata/sf0.01"))
    return materialize(session_features(rows), "model-features")


@pytest.fixture(scope="module")
def parts(features):
    return models.train_test_split(features)


@pytest.fixture(scope="module")
def fitted(parts):
    return scoring.fit_detectors(parts[0], QUICK)


def ids(frame):
    return {r["session_id"] for r in frame.select("session_id").collect()}


def test_exact_split(features, parts):
    train, test = map(ids, parts)
    assert len(test) == 30 and len(train) == 120 and not train & test
    again = models.train_test_split(features.repartition(5))
    assert ids(again[1]) == test
    assert ids(models.train_test_split(features, seed=7)[1]) != test


def test_hash_split(features):
    train, test = map(ids, models.train_test_split(features, exact=False))
    assert not train & test and len(train | test) == 150 and 15 < len(test) < 50


def test_first_part(features):
    first, rest = models.first_part(features, 0.6, [F.col("session_id")])
    assert first.count() == 90 and max(ids(first)) < min(ids(rest))


def test_seeded_order(features):
    order = [r["session_id"] for r in models.seeded_order(features, "session_id").collect()]
    assert order == [r["session_id"] for r in models.seeded_order(features.repartition(3), "session_id").collect()]
    assert order != sorted(order)


def test_feature_matrix(features):
    rows = models.feature_matrix(features).collect()
    assert all(len(r["features"]) == 51 and np.isfinite(r["features"].toArray()).all() for r in rows)
    assert {(r["traffic_class"], r["y_multi"]) for r in rows} == {
        ("human", 0), ("simple_bot", 1), ("scraper", 2), ("cred_stuffer", 3), ("llm_agent", 4)}


def test_scaler(features):
    matrix = models.feature_matrix(features)
    scaled = np.array([r["scaled"].toArray() for r in models.scaler().fit(matrix).transform(matrix).collect()])
    moving = scaled.std(axis=0) > 0
    assert np.allclose(scaled.mean(axis=0), 0, atol=1e-9) and np.allclose(scaled[:, moving].std(axis=0, ddof=1), 1)


def test_forest(fitted, parts):
    forest = fitted.forest
    assert forest.nodes["tree"].nunique() == 100 and forest.sample_size <= 256
    train_scores = [r[0] for r in models.with_forest(parts[0], forest).select("isolation_score").collect()]
    assert abs(min(train_scores)) < 1e-6 and abs(max(train_scores) - 1) < 1e-6
    scored = models.with_forest(parts[1], forest)
    judged = scored.select(F.col("label").alias("y_true"), F.col("isolation_score").alias("y_score"))
    assert evaluation.auroc(judged).first()[0] > 0.9
    assert scored.filter("isolation_prediction <> int(isolation_score > 0.5D)").count() == 0


def test_forest_does_not_depend_on_partitions(fitted, parts):
    again = models.fit_forest(parts[0].repartition(7), QUICK)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        fitted.forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True))


def test_forest_batch_range(fitted, parts):
    batch = [r[0] for r in models.with_forest(parts[1], fitted.forest, batch=True).select("isolation_score").collect()]
    assert abs(min(batch)) < 1e-6 and abs(max(batch) - 1) < 1e-6
    one = models.with_forest(parts[1].limit(1), fitted.forest, batch=True).first()
    assert one["isolation_score"] == 1.0


def test_tree_isolates_an_outlier():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(255, 3)), [[50.0, 50.0, 50.0]]])
    depths = []
    for seed in range(50):
        nodes = {n[0]: n for n in models.grow_tree(points, np.random.default_rng(seed))}
        at, depth = 0, 0
        while nodes[at][1] >= 0:
            _, feature, cut, left, right, _ = nodes[at]
            at, depth = (left if points[-1, feature] <= cut else right), depth + 1
        depths.append(depth)
    assert np.mean(depths) < 3
    assert models.grow_tree(np.ones((5, 2)), np.random.default_rng(0)) == [(0, -1, 0.0, -1, -1, models.expected_path(5))]


def test_boosting(spark, fitted, parts):
    scored = models.with_boosting(parts[0], fitted.boosting)
    assert scored.filter("gb_prediction <> label").count() <= 12
    assert scored.filter("gb_score < 0 or gb_score > 1").count() == 0
    assert abs(sum(fitted.boosting.importances().values()) - 1) < 1e-9
    top = models.top_features(spark, fitted.boosting, 5).collect()
    assert len(top) == 5 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True) and all(r["feature"] in FEATURE_NAMES and r["importance"] >= 0 for r in top)


def test_boosting_on_top_features(spark, fitted, parts):
    names = [r["feature"] for r in models.top_features(spark, fitted.boosting, 4).collect()]
    small = models.fit_boosting(parts[0], QUICK, names)
    assert small.names == tuple(names) and set(small.importances()) == set(names)


def test_too_few_sessions(parts):
    strict = replace(DEFAULT, models=ModelSettings(min_training_sessions=500))
    for fit in (models.fit_forest, models.fit_boosting):
        with pytest.raises(ValueError):
            fit(parts[0], strict)


def test_untrained_models_count_as_zero(parts):
    rows = scoring.score(parts[1]).select("isolation_score", "gb_score").distinct().collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0)]


def test_save_load_and_single_scoring(spark, fitted, parts):
    path = new_path(spark, "test-models")
    assert not scoring.saved_at(spark, path)
    fitted.save(spark, path)
    assert scoring.saved_at(spark, path)
    loaded, rest = scoring.load_or_fit(parts[1], path, QUICK)
    columns = ["session_id", "isolation_score", "gb_score", "risk_score", "n_detectors_firing", "explanation"]
    whole = {r["session_id"]: tuple(r) for r in scoring.score(parts[1], fitted).select(columns).collect()}
    assert {r["session_id"]: tuple(r) for r in scoring.score(rest, loaded).select(columns).collect()} == whole
    name = min(whole)
    assert tuple(scoring.score(parts[1].filter(F.col("session_id") == name), fitted).select(columns).first()) == whole[name]
    assert all(0 <= r[3] <= 1 for r in whole.values())


def test_a_save_that_dies_leaves_the_version_before(spark, fitted, monkeypatch):
    path = new_path(spark, "test-store")
    with pytest.raises(FileNotFoundError):
        scoring.Detectors.load(spark, path)
    first = fitted.save(spark, path)
    other = scoring.Detectors(fitted.forest, boosting.first_trees(fitted.boosting, 2))

    def dies(*args):
        raise OSError("disk gone")

    with monkeypatch.context() as patched:
        patched.setattr(boosting, "save", dies)
        with pytest.raises(OSError):
            other.save(spark, path)
    assert store.versions(spark, path) == [first]
    assert len(scoring.Detectors.load(spark, path).boosting.feature) == 8
    second = other.save(spark, path)
    assert store.versions(spark, path) == [second, first]
    assert len(scoring.Detectors.load(spark, path).boosting.feature) == 2
    assert len(scoring.Detectors.load(spark, path, first).boosting.feature) == 8
    # the half-written one goes as well: it is older than the version kept
    assert len(store.prune(spark, path, 1)) == 2 and store.versions(spark, path) == [second]


def test_load_or_fit_without_models(spark, features):
    detectors, rest = scoring.load_or_fit(features, new_path(spark, "nothing"), replace(QUICK, models=ModelSettings(boost_trees=2)))
    assert rest.count() == 60 and detectors.forest.nodes["tree"].nunique() == 100


def test_train_and_evaluate(spark):
    rows = requests_from_events(read_events(spark, "/root/testdata/sf0.01"))
    out = tempfile.mkdtemp(prefix="trafficlens-test-")
    report = scoring.train_and_evaluate(rows, out, replace(QUICK, models=ModelSettings(boost_trees=3))).first()
    assert report["recall"] > 0.8 and report["fpr"] <= 0.01 and report["auroc"] > 0.9
    written = [f for f in os.listdir(f"{out}/report") if f.endswith(".json")]
    assert json.loads(open(f"{out}/report/{written[0]}").read())["tp"] == report["tp"]


def test_a_cut_between_neighbouring_numbers_leaves_rows_on_both_sides():
    low = 0.1
    points = np.array([[low], [np.nextafter(low, 1.0)]])
    for seed in range(50):
        nodes = models.grow_tree(points, np.random.default_rng(seed))
        assert len(nodes) == 3 and nodes[0][2] == low
