"""Detection quality. Input has y_true (0 or 1) and y_score, one row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.functions import columns
from trafficlens.operators.skew import cumulative

# 90 cut points from 0.10 to 0.99.
THRESHOLDS = tuple(0.1 + i * ((0.99 - 0.1) / 89) for i in range(89)) + (0.99,)
# those, and the cut that stands where none of them fits
OBSERVED = tuple(sorted({*THRESHOLDS, 0.5}))


def _rates(counts: DataFrame) -> DataFrame:
    """Rates from tp, fp, tn, fn, rounded to four digits like a report."""
    exact = {"precision": "_p", "recall": "_r", "fpr": "fp / double(greatest(fp + tn, 1))",
             "fnr": "fn / double(greatest(fn + tp, 1))",
             "accuracy": "(tp + tn) / double(greatest(tp + fp + tn + fn, 1))",
             "f1": "2D * _p * _r / greatest(_p + _r, 1e-9D)"}
    return (counts
            .selectExpr("*", "tp / double(greatest(tp + fp, 1)) as _p", "tp / double(greatest(tp + fn, 1)) as _r")
            .selectExpr("*", *[f"{columns.exact_round(v)} as {k}" for k, v in exact.items()])
            .drop("_p", "_r"))


def confusion_metrics(scored: DataFrame, threshold: float = 0.5,
                      prediction: str | None = None) -> DataFrame:
    """One row of counts and rates. With `prediction` that column is used instead of the score."""
    hit = f"{prediction} = 1" if prediction else f"y_score >= {threshold!r}D"
    counts = scored.groupBy().agg(*[
        F.expr(f"count_if({condition}) as {name}") for name, condition in {
            "tp": f"y_true = 1 and {hit}", "fp": f"y_true = 0 and {hit}",
            "tn": f"y_true = 0 and not ({hit})", "fn": f"y_true = 1 and not ({hit})"}.items()])
    return _rates(counts).withColumn("threshold", F.lit(float(threshold)))


def curve_points(scored: DataFrame) -> DataFrame:
    """Per distinct score from high to low: own and cumulative true and false positives.

    Scores are grouped first, then summed over range partitions; no task sees all scores.
    """
    grouped = scored.groupBy("y_score").agg(F.expr("count_if(y_true = 1) as pos"),
                                            F.expr("count_if(y_true = 0) as neg"))
    return cumulative(grouped, [F.desc("y_score")], {"tp": F.col("pos"), "fp": F.col("neg")}, "curve")


def _with_totals(points: DataFrame) -> DataFrame:
    """Adds all_pos and all_neg. Curve points are stored, so the totals are a small side job."""
    total = points.groupBy().agg(F.struct(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"),
                                          F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))).scalar()
    return points.select("*", total["p"].alias("all_pos"), total["n"].alias("all_neg"))


def roc_curve(scored: DataFrame, points: DataFrame | None = None) -> DataFrame:
    return _with_totals(points or curve_points(scored)).selectExpr(
        "y_score as threshold", "tp", "fp", "tp / double(greatest(all_pos, 1)) as tpr",
        "fp / double(greatest(all_neg, 1)) as fpr")


def pr_curve(scored: DataFrame, points: DataFrame | None = None) -> DataFrame:
    return _with_totals(points or curve_points(scored)).selectExpr(
        "y_score as threshold", "tp", "fp", "tp / double(greatest(tp + fp, 1)) as precision",
        "tp / double(greatest(all_pos, 1)) as recall")


def auroc(scored: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Trapezoids from (0, 0) through every score to (1, 1)."""
    steps = _with_totals(points or curve_points(scored)).selectExpr(
        "all_pos", "all_neg",
        "neg / double(greatest(all_neg, 1)) * (tp + tp - pos) / double(greatest(all_pos, 1)) / 2D as area",
        "tp / double(greatest(all_pos, 1)) as tpr", "fp / double(greatest(all_neg, 1)) as fpr")
    return steps.groupBy().agg(F.expr("sum(area) + (1D - max(fpr)) * (1D + max(tpr)) / 2D as auroc"))


def auprc(scored: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Trapezoids over recall, starting at recall 0 with precision 1; no end point is added."""
    steps = _with_totals(points or curve_points(scored)).selectExpr(
        "pos / double(greatest(all_pos, 1)) as step",
        "tp / double(greatest(tp + fp, 1)) as here",
        """if(tp + fp = pos + neg, 1D,
              (tp - pos) / double(greatest(tp + fp - pos - neg, 1))) as before""")
    return steps.groupBy().agg(F.expr("sum(step * (here + before) / 2D) as auprc"))


def full_report(scored: DataFrame, threshold: float = 0.5, row: DataFrame | None = None) -> DataFrame:
    """Counts, rates and both areas in one row. `row` has the counts and rates if they are known already."""
    points = curve_points(scored)
    row = confusion_metrics(scored, threshold) if row is None else row
    areas = row.select("*", auroc(scored, points).scalar().alias("_roc"), auprc(scored, points).scalar().alias("_pr"))
    return areas.selectExpr("*", f"{columns.exact_round('_roc')} as auroc",
                            f"{columns.exact_round('_pr')} as auprc").drop("_roc", "_pr")


def per_class_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """People: false positives. Every other class: what was detected and missed."""
    hits = scored.groupBy("traffic_class").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count_if(y_score >= {threshold!r}D) as flagged"))
    human = "traffic_class = 'human'"
    share = columns.exact_round("flagged / double(greatest(n, 1))")
    return hits.selectExpr(
        "traffic_class", "n",
        f"if({human}, {share}, null) as fpr", f"if({human}, flagged, null) as false_positives",
        f"if({human}, n - flagged, null) as correctly_allowed",
        f"if({human}, null, {share}) as recall", f"if({human}, null, flagged) as detected",
        f"if({human}, null, n - flagged) as missed")


def threshold_grid(scored: DataFrame) -> DataFrame:
    """Counts and rates at each of the 90 cut points, in one pass over the scores.

    Every score goes to the bucket of the highest cut point it reaches; at most 91 buckets are
    left after the aggregation, and suffix sums over them give the counts at each cut.
    """
    spark = scored.sparkSession
    cuts = F.array(*[F.lit(t) for t in THRESHOLDS])
    reached = F.aggregate(cuts, F.lit(0), lambda acc, t: acc + F.when(F.col("y_score") >= t, 1).otherwise(0))
    # equal scores first: the steps are looked up once per distinct score
    distinct = scored.groupBy("y_score").agg(F.expr("count_if(y_true = 1) as pos"), F.expr("count_if(y_true = 0) as neg"))
    buckets = distinct.groupBy(reached.alias("bucket")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # step 0 is reached by every score and so holds the totals
    grid = spark.createDataFrame(list(enumerate((0.0, *THRESHOLDS))), "step int, threshold double")
    spread = buckets.select("pos", "neg", F.explode(F.sequence(F.lit(0), "bucket")).alias("step"))
    counts = spread.groupBy("step").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    steps = Window.partitionBy()
    filled = (grid.join(F.broadcast(counts), "step", "left")
              .withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", F.coalesce("fp", F.lit(0)))
              .withColumn("fn", F.max("tp").over(steps) - F.col("tp"))
              .withColumn("tn", F.max("fp").over(steps) - F.col("fp")))
    return _rates(filled.filter("step > 0").select("threshold", "tp", "fp", "tn", "fn"))


def optimal_threshold(scored: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    """Lowest cut point with the best recall among those within the target; 0.5 if none has any."""
    return best_of_grid(threshold_grid(scored), target_fpr)


def best_of_grid(grid: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    fit = grid.filter(f"fpr <= {target_fpr!r}D and recall > 0")
    best = fit.groupBy().agg(F.max_by(F.struct("threshold", "recall", "fpr"),
                                      F.struct(F.col("recall"), -F.col("threshold"))).alias("b"))
    return best.selectExpr("coalesce(b.threshold, 0.5D) as threshold", "b.recall as recall", "b.fpr as fpr")


def observed(scored: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and what will be known of them once they have been written: counts at every cut point and at 0.5."""
    watch = Observation("scores")
    counts = [F.expr(f"count_if(y_true = {y} and y_score >= {t!r}D) as {n}{k}") for k, t in enumerate(OBSERVED) for n, y in (("tp", 1), ("fp", 0))]
    return scored.observe(watch, F.expr("count_if(y_true = 1) as pos"), F.expr("count_if(y_true = 0) as neg"), *counts), watch


def observed_grid(spark: SparkSession, watch: Observation) -> DataFrame:
    """`threshold_grid`, and a row for 0.5, from an observed write; no row is read again."""
    c = watch.get
    rows = [(t, c[f"tp{k}"], c[f"fp{k}"], c["neg"] - c[f"fp{k}"], c["pos"] - c[f"tp{k}"]) for k, t in enumerate(OBSERVED)]
    return _rates(spark.createDataFrame(rows, "threshold double, tp bigint, fp bigint, tn bigint, fn bigint"))


def metric_flags(metrics: DataFrame) -> DataFrame:
    return metrics.selectExpr("fpr", "recall", "if(fpr > 0.02D, 'HIGH', 'OK') as fpr_flag",
                              "if(recall < 0.90D, 'LOW', 'OK') as recall_flag")


def scores_by_class(scored: DataFrame) -> DataFrame:
    columns = ("statistical_score", "isolation_score", "gb_score", "llm_score", "risk_score")
    return scored.groupBy("traffic_class").agg(*[F.avg(c).alias(c) for c in columns])
