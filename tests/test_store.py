"""The request table by session, day sketches, and counts taken while scores are written."""

import uuid

from pyspark.sql import functions as F

from trafficlens.operators import evaluation, extras
from trafficlens.operators.features import session_features
from trafficlens.operators.skew import materialize, new_path
from trafficlens.sources import store


def test_features_of_a_store_need_no_exchange(spark, requests):
    name, path = f"requests_{uuid.uuid4().hex}", new_path(spark, "test-store")
    stored = store.write_store(requests, name, 4, path)
    features = session_features(stored)
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = sorted(map(str, session_features(requests).collect()))
    assert sorted(map(str, features.collect())) == want
    # another application names the folder again
    spark.sql(f"drop table {name}")
    again = store.open_store(spark, f"again_{uuid.uuid4().hex}", 4, path, requests)
    assert "Exchange" not in session_features(again)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, session_features(again).collect())) == want


def test_day_sketches_stay_within_their_error(spark):
    rows = spark.range(0, 60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20_000).cast("string").alias("v"),
                                         ((F.col("id") % 7) * extras.DAY_MS + 5).cast("double").alias("timestamp_ms"))
    sketches = materialize(extras.day_sketches(rows, ["k"], "v"), "test-sketches")
    assert sketches.count() == 21
    for first, last in ((None, None), (2, 4), (3, 3), (9, 12)):
        inside = rows.filter(F.floor(F.col("timestamp_ms") / extras.DAY_MS).between(0 if first is None else first, 99 if last is None else last))
        exact = {r["k"]: r["n"] for r in inside.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
        found = {r["k"]: r["n_distinct"] for r in extras.distinct_over_days(sketches, ["k"], first, last).collect()}
        # four times the relative standard error
        assert found.keys() == exact.keys() and all(abs(found[k] - n) <= 4 * 1.04 / 2 ** (extras.REGISTERS / 2) * n for k, n in exact.items())


def test_observed_counts_equal_the_grid(spark):
    rows = spark.range(0, 500).select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y_true"),
                                      (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(101)) / 100.0).alias("y_score"))
    watched, watch = evaluation.observed(rows)
    materialize(watched, "test-observed")
    grid = evaluation.observed_grid(spark, watch)
    want = {r["threshold"]: r for r in evaluation.threshold_grid(rows).collect()}
    got = {r["threshold"]: r for r in grid.collect()}
    names = ["tp", "fp", "tn", "fn", "precision", "recall", "fpr", "fnr", "accuracy", "f1"]
    assert len(got) >= 90 and all([got[t][n] for n in names] == [want[t][n] for n in names] for t in want)
    half = evaluation.confusion_metrics(rows, 0.5).first()
    assert all(got[0.5][n] == half[n] for n in names)
