"""Train/test split, feature vectors, isolation forest and boosted trees.

Boosting is that of `boosting.py`. MLlib has no isolation forest (Liu, Ting, Zhou 2008), so it is built here: each
tree needs at most 256 rows, trees grow in parallel, and scoring reads one small node table.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, ModelSettings, Settings
from trafficlens.functions.columns import class_label
from trafficlens.operators import boosting
from trafficlens.operators.features import FEATURE_NAMES
from trafficlens.operators.skew import number_rows

# functions of this module travel inside the UDFs, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329


# --- splits and vectors ------------------------------------------------------------------------

def train_test_split(df: DataFrame, fraction: float = 0.2, seed: int = 42, key: str = "session_id",
                     exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows in the order of a seeded hash of the key.

    Exact gives floor(n * fraction) test rows and stores the numbered frame once, which a fit then
    reads many times. Otherwise rows are split by hash alone: no shuffle, size within sampling error.
    """
    if not exact:
        low = F.conv(F.substring(seeded_keys(key, seed)[0], 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32)
        return df.filter(~low), df.filter(low)
    numbered = number_rows(df, seeded_keys(key, seed), "split")
    n_test = int(numbered.count() * fraction)
    return (numbered.filter(F.col("row_no") > n_test).drop("row_no"),
            numbered.filter(F.col("row_no") <= n_test).drop("row_no"))


def seeded_keys(key: str, seed: int = 42) -> list[Column]:
    """Sort keys of a repeatable shuffle: the MD5 of key and seed, then the key."""
    return [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]


def first_part(df: DataFrame, fraction: float, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The first rows of an order, and the rest."""
    numbered = number_rows(df, order, "first")
    cut = int(numbered.count() * fraction)
    return (numbered.filter(F.col("row_no") <= cut).drop("row_no"),
            numbered.filter(F.col("row_no") > cut).drop("row_no"))


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable shuffle: range-partitioned sort on a hash."""
    return df.orderBy(*seeded_keys(key, seed))


def assembler(names: Sequence[str] = FEATURE_NAMES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features")


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def feature_matrix(features: DataFrame) -> DataFrame:
    """Session id, labels and the feature vector."""
    return (assembler().transform(features)
            .select("session_id", "traffic_class", F.col("label").alias("y_binary"),
                    class_label(F.col("traffic_class")).alias("y_multi"), "features"))


def _require_rows(df: DataFrame, settings: ModelSettings) -> None:
    least = settings.min_training_sessions
    if least and df.count() < least:
        raise ValueError(f"fewer than {least} training sessions")


# --- boosted trees -------------------------------------------------------------------------------

def fit_boosting(train: DataFrame, config: Settings = DEFAULT,
                 names: Sequence[str] | None = None) -> boosting.BoostedModel:
    """Boosted trees on the label; `names` limits the vector to some features. Trees need no scaled features."""
    _require_rows(train, config.models)
    return boosting.fit(train, names or FEATURE_NAMES, config.models)


def fit_boosting_on_best(train: DataFrame, config: Settings = DEFAULT) -> boosting.BoostedModel:
    """Boosted trees on the `top_features` most important features of a first fit on all."""
    first = fit_boosting(train, config)
    best = top_features(train.sparkSession, first, config.models.top_features).collect()
    return fit_boosting(train, config, [row["feature"] for row in best])


def with_boosting(features: DataFrame, model: boosting.BoostedModel) -> DataFrame:
    """Adds gb_score (probability of class 1) and gb_prediction."""
    return (features.withColumn("gb_score", boosting.probability(model, features.sparkSession))
            .withColumn("gb_prediction", (F.col("gb_score") > 0.5).cast("int")))


def top_features(spark: SparkSession, model: boosting.BoostedModel, n: int = 15) -> DataFrame:
    """The n features with the highest importance."""
    return (spark.createDataFrame(list(model.importances().items()), "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(n))


# --- isolation forest ---------------------------------------------------------------------------

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "path double")


def expected_path(size: float) -> float:
    """Mean depth of an unsuccessful search among `size` points."""
    if size <= 1:
        return 0.0
    if size <= 2:
        return 1.0
    return 2.0 * (np.log(size - 1.0) + EULER_GAMMA) - 2.0 * (size - 1.0) / size


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path); leaves have feature -1."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(points)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes[at] = (at, -1, 0.0, -1, -1, depth + expected_path(len(rows)))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        # between two neighbouring numbers the draw may round up to the higher one, which would leave no row on the right
        cut = cut if cut < high[feature] else float(low[feature])
        goes_left = points[rows, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (at, feature, cut, left, right, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


@dataclass(frozen=True)
class ForestModel:
    """Node table and the range of raw scores seen at fit.

    Features are not standardised: a random cut between the lowest and highest value falls in the
    same place on any linear scale, and unscaled cuts do not depend on the order of a sum.
    """

    names: tuple[str, ...]
    nodes: pd.DataFrame
    sample_size: int
    raw_min: float
    raw_max: float

    def tables(self) -> dict[str, np.ndarray]:
        """Nodes as arrays of shape (trees, nodes)."""
        shape = (self.nodes["tree"].max() + 1, self.nodes["node"].max() + 1)
        found = {}
        for name in ("feature", "threshold", "left", "right", "path"):
            values = np.zeros(shape, dtype=self.nodes[name].dtype)
            values[self.nodes["tree"], self.nodes["node"]] = self.nodes[name]
            found[name] = values
        return found


def _sample_per_tree(humans: DataFrame, n_rows: int, m: ModelSettings) -> DataFrame:
    """(session_id, tree, rank): the rows with the smallest seeded hashes, per tree.

    A threshold on the hash keeps about four times the rows wanted, so that only those are shuffled.
    """
    share = min(1.0, 4.0 * m.forest_sample / max(n_rows, 1))
    limit = int(-2**63 + share * (2**64 - 1))
    trees = F.filter(F.sequence(F.lit(0), F.lit(m.forest_trees - 1)),
                     lambda t: F.xxhash64(F.col("session_id"), t, F.lit(m.seed)) <= min(limit, 2**63 - 1))
    chosen = (humans.select("session_id", F.explode(trees).alias("tree"))
              .withColumn("_hash", F.xxhash64("session_id", "tree", F.lit(m.seed))))
    by_hash = Window.partitionBy("tree").orderBy("_hash", "session_id")
    return (chosen.withColumn("rank", F.row_number().over(by_hash))
            .filter(F.col("rank") <= m.forest_sample).drop("_hash"))


def fit_forest(train: DataFrame, config: Settings = DEFAULT,
               names: Sequence[str] = FEATURE_NAMES) -> ForestModel:
    """Forest on human sessions; raw score range frozen over all training sessions."""
    m = config.models
    _require_rows(train, m)
    humans = train.filter("label = 0")
    n_humans = humans.count()
    if not n_humans:
        raise ValueError("no human sessions to fit on")
    seed = m.seed

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        rows = part.sort_values("rank")
        nodes = grow_tree(np.array(rows["x"].tolist()), np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *n) for n in nodes],
                            columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    picks = _sample_per_tree(humans, n_humans, m)  # at most trees * sample rows
    points = (humans.select("session_id", F.array(*names).alias("x"))
              .join(F.broadcast(picks), "session_id"))
    # at most trees * (2 * sample - 1) rows, whatever the size of the training set
    nodes = points.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    sample = int(min(m.forest_sample, n_humans))
    grown = ForestModel(tuple(names), nodes, sample, 0.0, 1.0)
    raw = train.select(raw_normality(grown, train.sparkSession).alias("r"))
    span = raw.agg(F.min("r"), F.max("r")).first()
    return ForestModel(tuple(names), nodes, sample, span[0], span[1])


def raw_normality(model: ForestModel, spark: SparkSession) -> Column:
    """-2^(-E[h]/c): close to 0 for normal rows, towards -1 for isolated ones."""
    tables = model.tables()
    depth = int(np.ceil(np.log2(max(model.sample_size, 2))))
    shared = spark.sparkContext.broadcast(tables)
    unit = expected_path(model.sample_size) or 1.0

    @F.pandas_udf("double")
    def normality(x: pd.Series) -> pd.Series:
        nodes = shared.value
        points = np.array(x.tolist())
        rows = np.arange(len(points))[:, None]
        trees = np.arange(nodes["feature"].shape[0])[None, :]
        at = np.zeros((len(points), trees.shape[1]), dtype=np.int64)
        for _ in range(depth):
            feature = nodes["feature"][trees, at]
            left = points[rows, np.maximum(feature, 0)] <= nodes["threshold"][trees, at]
            step = np.where(left, nodes["left"][trees, at], nodes["right"][trees, at])
            at = np.where(feature >= 0, step, at)
        path = nodes["path"][trees, at].mean(axis=1)
        return pd.Series(-np.power(2.0, -path / unit))

    return normality(F.array(*model.names))


def with_forest(features: DataFrame, model: ForestModel, batch: bool = False) -> DataFrame:
    """Adds isolation_score in 0..1 (1 = most isolated) and isolation_prediction (score > 0.5).

    With `batch` the range of raw scores is taken from this frame instead of the fit.
    """
    raw = features.withColumn("_raw", raw_normality(model, features.sparkSession))
    low, high = F.lit(model.raw_min), F.lit(model.raw_max)
    if batch:
        span = raw.groupBy().agg(F.min("_raw").alias("low"), F.max("_raw").alias("high"))
        low, high = span.select("low").scalar(), span.select("high").scalar()
    score = 1.0 - (F.col("_raw") - low) / (high - low + 1e-9)
    return (raw.withColumn("isolation_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
            .withColumn("isolation_prediction", (F.col("isolation_score") > 0.5).cast("int"))
            .drop("_raw"))


def save_forest(spark: SparkSession, model: ForestModel, path: str) -> None:
    spark.createDataFrame(model.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
    names = list(enumerate(model.names))
    (spark.createDataFrame(names, "position int, name string").write.mode("overwrite").parquet(f"{path}/names"))
    (spark.createDataFrame([(model.sample_size, model.raw_min, model.raw_max)],
                           "sample_size int, raw_min double, raw_max double")
     .write.mode("overwrite").parquet(f"{path}/range"))


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    names = spark.read.parquet(f"{path}/names").orderBy("position").collect()
    found = spark.read.parquet(f"{path}/range").first()
    return ForestModel(tuple(r["name"] for r in names), nodes, found["sample_size"], found["raw_min"], found["raw_max"])
