"""Histogram boosting against a plain loop over rows, and against MLlib's trees."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trafficlens.config import ModelSettings
from trafficlens.operators import boosting, evaluation

NAMES = ("a", "b", "c", "same")
SMALL = ModelSettings(boost_trees=6, boost_depth=3, boost_rate=0.3, boost_subsample=1.0)


def rows(n, seed=0):
    draw = np.random.default_rng(seed)
    a, b, c = draw.integers(0, 9, n) / 2, draw.normal(size=n).round(1), draw.integers(0, 3, n) * 1.0
    y = ((a > 2) ^ (b > 0.3) | (draw.random(n) < 0.1)).astype(int)
    return [(f"s{i}", float(a[i]), float(b[i]), float(c[i]), 7.0, int(y[i])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "session_id string, a double, b double, c double, same double, label int")


def grown(points, y, m, edges):
    """The same trees by loops: margins of all rows and the cuts of every tree."""
    share = sum(y) / len(y)
    margin, trees = [math.log(share / (1 - share))] * len(y), []
    scale = 2.0 ** boosting.SCALE_BITS
    for _ in range(m.boost_trees):
        p = [1 / (1 + math.exp(-v)) for v in margin]
        g = [round((t - q) * scale) / scale for t, q in zip(y, p)]
        h = [round(q * (1 - q) * scale) / scale for q in p]
        tree, todo = {}, [(0, list(range(len(y))), 0)]

        def leaf(members):
            return m.boost_rate * sum(g[i] for i in members) / (sum(h[i] for i in members) + boosting.SMOOTH)

        def gain(members):
            return sum(g[i] for i in members) ** 2 / (sum(h[i] for i in members) + boosting.SMOOTH)

        while todo:
            node, members, depth = todo.pop()
            best = (boosting.LEAST_GAIN, None)
            if depth < m.boost_depth:
                for f in range(points.shape[1]):
                    for cut in edges[f]:
                        left = [i for i in members if points[i, f] <= cut]
                        right = [i for i in members if points[i, f] > cut]
                        if left and right:
                            found = gain(left) + gain(right) - gain(members)
                            if found > best[0] + 1e-12:
                                best = (found, (f, float(cut), left, right))
            if best[1] is None:
                value = leaf(members)
                for i in members:
                    margin[i] += value
                continue
            f, cut, left, right = best[1]
            tree[node] = (f, cut)
            todo += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
        trees.append(tree)
    return margin, trees


def test_trees_equal_loops(spark):
    data = rows(150)
    df = frame(spark, data)
    points, y = np.array([r[1:5] for r in data]), [r[5] for r in data]
    model = boosting.fit(df, NAMES, SMALL)
    margin, trees = grown(points, y, SMALL, boosting.bin_edges(df, NAMES))
    found = [{k: (int(model.feature[t, k]), float(model.threshold[t, k])) for k in np.flatnonzero(model.feature[t] >= 0).tolist()} for t in range(6)]
    assert found == trees and np.abs(model.margins(points) - margin).max() < 1e-9
    scored = {r["session_id"]: r["p"] for r in df.withColumn("p", boosting.probability(model, spark)).collect()}
    assert all(abs(scored[r[0]] - 1 / (1 + math.exp(-v))) < 1e-9 for r, v in zip(data, margin))
    assert model.importances()["same"] == 0 and abs(sum(model.importances().values()) - 1) < 1e-12


def same(a, b):
    return a.base == b.base and all((getattr(a, n) == getattr(b, n)).all() for n in ("feature", "threshold", "value", "gain"))


def test_trees_do_not_depend_on_partitions_or_blocks(spark, monkeypatch):
    df = frame(spark, rows(600, 1))
    drawn = replace(SMALL, boost_subsample=0.7)
    model = boosting.fit(df.repartition(3), NAMES, drawn)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 2)
    assert same(model, boosting.fit(df.repartition(7), NAMES, drawn))
    # sums added up in tasks instead of on the driver
    assert same(model, boosting.fit(df.repartition(90), NAMES, drawn))
    assert not same(model, boosting.fit(df, NAMES, replace(drawn, seed=7)))


def test_a_subsample_is_a_share_of_the_rows():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 20_000, np.uint64)
    first, second = boosting._drawn(keys, 0, 0.8), boosting._drawn(keys, 1, 0.8)
    assert abs(first.mean() - 0.8) < 0.02 and abs((first & second).mean() - 0.64) < 0.02
    assert boosting._drawn(keys, 3, 1.0).all() and not boosting._drawn(keys, 3, 0.0).any()


def test_as_good_as_mllib(spark):
    train, test = frame(spark, rows(3000, 3)), frame(spark, rows(1500, 4))
    settings = ModelSettings(boost_trees=30, boost_depth=4, boost_rate=0.1)
    model = boosting.fit(train, NAMES, settings)
    vector = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    other = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=1).fit(vector.transform(train))
    own = test.withColumn("y_score", boosting.probability(model, spark))
    theirs = other.transform(vector.transform(test)).withColumn("y_score", vector_to_array("probability")[1])
    areas = [evaluation.auroc(s.select(F.col("label").alias("y_true"), "y_score")).first()[0] for s in (own, theirs)]
    assert areas[0] > areas[1] - 0.01 and areas[0] > 0.85


def test_odd_tables(spark):
    with pytest.raises(ValueError):
        boosting.fit(frame(spark, []), NAMES, SMALL)
    one = boosting.fit(frame(spark, [r[:5] + (1,) for r in rows(20)]), NAMES, SMALL)
    assert (one.margins(np.array([[1.0, 2.0, 3.0, 7.0]])) > 5).all()
    with_nulls = frame(spark, [*rows(40), ("x", None, None, None, None, 1)])
    assert len(boosting.fit(with_nulls.na.fill(0.0), NAMES, SMALL).feature) == 6


def test_stored_trees_are_the_same(spark):
    from trafficlens.operators.skew import new_path
    model, path = boosting.fit(frame(spark, rows(100)), NAMES, SMALL), new_path(spark, "test-boosting")
    boosting.save(spark, model, path)
    assert same(model, boosting.load(spark, path)) and boosting.load(spark, path).names == NAMES
    assert boosting.first_trees(model, 2).feature.shape[0] == 2


def test_sums_stay_in_tasks(spark, monkeypatch):
    """One partition or many, by the sessions: the same trees, and only a few numbers of each node reach the driver."""
    df, sent = frame(spark, rows(600, 1)).repartition(40), []
    whole = boosting._level_cuts

    def seen(sums, level, rate):
        found = whole(sums, level, rate)
        sent.append((sums.getNumPartitions(), level, found))
        return found

    monkeypatch.setattr(boosting, "_level_cuts", seen)
    model = boosting.fit(df, NAMES, SMALL)
    assert {parts for parts, _, _ in sent} == {1}
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "PART_ROWS", 100)
    sent.clear()
    assert same(model, boosting.fit(df, NAMES, SMALL)) and max(parts for parts, _, _ in sent) > 3
    assert all(len(found) <= len(NAMES) << level and all(isinstance(v, (int, float)) for row in found for v in row) for _, level, found in sent)
