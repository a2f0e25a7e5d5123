"""Late-delivery classifiers with ``pyspark.ml``.

Training reads the features several times, so the training rows are persisted (spilling to
disk) while a model is fitted, and checkpoints of boosted trees go to the shared folder.
Only fitted models and vocabularies reach the driver. Rows equal in all features and the label
are trained on as one row that weighs their number, which is the same sum of losses and counts.

A model depends on the rows alone, not on how they lie. Numerics enter trees as exact quantile
bins, so no split candidates are drawn from a sample. The forest's bootstrap weights come from a
hash of each row and the number of its sample; the library's own sampling, which goes by partition,
is off. Trees of a forest stand in groups that share a sample and differ by the features tried at
each node; the groups' probabilities are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import column_quantiles
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.files import stored
from .boosting import CodedBoosting, Columns
from .ml_data import CATEGORICAL, NUMERIC

LOGISTIC_REGRESSION = "logistic_regression"
DECISION_TREE = "decision_tree"
RANDOM_FOREST = "random_forest"
GRADIENT_BOOSTING = "gradient_boosting"
MODELS = (LOGISTIC_REGRESSION, DECISION_TREE, RANDOM_FOREST, GRADIENT_BOOSTING)


def ml_preprocess(variant: str = "A") -> Pipeline:
    """Features to one vector: numerics (standardised in A) and one-hot categories.

    A category unseen in training becomes all zeros: the indexer gives it an extra index,
    which is the one the encoder drops.
    """
    categories, numerics = list(CATEGORICAL[variant]), list(NUMERIC[variant])
    indexed, encoded = [f"{c}__index" for c in categories], [f"{c}__onehot" for c in categories]
    stages = [
        StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=numerics, outputCol="numerics"),
    ]
    numeric_vector = "numerics"
    if variant == "A":
        stages.append(StandardScaler(inputCol="numerics", outputCol="scaled", withMean=True, withStd=True))
        numeric_vector = "scaled"
    stages.append(VectorAssembler(inputCols=[numeric_vector, *encoded], outputCol="features"))
    return Pipeline(stages=stages)


def classifier(name: str, n_rows: int, seed: int = 42, **overrides) -> Estimator:
    """An unfitted classifier but the forest; ``n_rows`` sets the L2 weight (one over the training size)."""
    if name == LOGISTIC_REGRESSION:
        options = dict(maxIter=1000, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False)
        return LogisticRegression(**{**options, **overrides})
    trees = dict(featuresCol="tree_features", seed=seed, maxMemoryInMB=TREE_MEMORY_MB)
    if name == DECISION_TREE:
        return DecisionTreeClassifier(**{**trees, **dict(maxDepth=8), **overrides})
    if name == GRADIENT_BOOSTING:
        return CodedBoosting(**{**trees, **dict(maxIter=100, maxDepth=3, stepSize=0.1), **overrides})
    raise ValueError(f"unknown model {name}")


#: Rows of a training partition, where there are more of them than cores.
ROWS_PER_PARTITION = 200_000
#: Rows of a forest's partition, where there are more of them than cores.
ROWS_PER_FOREST_PARTITION = 4_000_000
#: Rows of a partition of one bootstrap sample, where the forest's partitions are more than the samples fitted at once need.
ROWS_PER_SAMPLE_PARTITION = 500_000
#: Bins of a numeric feature in trees; the library's own number of split candidates plus one.
BINS = 32
#: Bootstrap samples of a forest; its trees are dealt to them.
SAMPLES = 4
#: Memory for the node statistics of a pass, in MB; more of it means fewer passes over the rows.
TREE_MEMORY_MB = 256


def training_partitions(n_rows: int, cores: int) -> int:
    """One partition per core, or as many as hold ``ROWS_PER_PARTITION`` rows each if that is more."""
    return max(cores, -(-n_rows // ROWS_PER_PARTITION), 1)


def forest_partitions(n_rows: int, cores: int) -> int:
    """One partition per core, or as many as hold ``ROWS_PER_FOREST_PARTITION`` rows each if that is more.

    In each pass every partition sends the statistics of all open nodes, hundreds of thousands of them
    in a deep forest, so what is shuffled grows with the partitions and not with the rows.
    """
    return max(cores, -(-n_rows // ROWS_PER_FOREST_PARTITION), 1)


def samples_at_once(samples: int, partitions: int) -> int:
    """How many bootstrap samples are fitted at once, so that each has two of the forest's partitions at least."""
    at_once = samples
    while at_once > 1 and 2 * at_once > partitions:
        at_once = (at_once + 1) // 2
    return at_once


def sample_partitions(n_rows: int, partitions: int, at_once: int) -> int:
    """The share of one sample in the forest's partitions, or as many of them as ``n_rows`` need.

    Samples fitted at once fill the cores together. Each with all partitions would send the statistics
    of its nodes from every one of them.
    """
    return max(min(partitions, max(partitions // at_once, -(-n_rows // ROWS_PER_SAMPLE_PARTITION))), 1)


def over_cores(rows: DataFrame) -> DataFrame:
    """The rows in one partition per core at least: a table of few files is read, and would be scored, in few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def with_poisson_weight(rows: DataFrame, sample: int, seed: int) -> DataFrame:
    """Add ``weight``, Poisson with mean one, from the hash in ``place``: the same row always has the same one."""
    draw = F.shiftrightunsigned(F.xxhash64("place", F.lit(sample), F.lit(seed)), 11) / F.lit(float(1 << 53))
    edges = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    weight = sum(((F.col("draw") >= edge).cast("double") for edge in edges), F.lit(0.0))
    return rows.withColumn("draw", draw).withColumn("weight", weight).drop("draw")


def distinct_rows_weighed(train: DataFrame) -> DataFrame:
    """Each distinct row with ``place``, its hash, and ``n_equal``, the number of rows equal to it; written once.

    Repeats are counted before the shuffle, so a row that makes up a third of all is one row per task.
    """
    counted = train.groupBy(*train.columns).agg(F.count("*").cast("double").alias("n_equal"))
    return stored(counted.withColumn("place", F.xxhash64(*[F.col(c) for c in train.columns])), "training-rows", "zstd")


def quantile_bins(rows: DataFrame, variant: str) -> list:
    """Stages that put the numerics into bins of about equal size, and these and the categories into one vector.

    ``rows`` are those of ``distinct_rows_weighed``; each counts as often as it occurs.
    """
    names = list(NUMERIC[variant])
    probabilities = [i / BINS for i in range(1, BINS)]
    # One row per numeric column.
    quantiles = column_quantiles(rows, names, probabilities, F.col("n_equal").cast("bigint"))
    found = {r["column_name"]: r["quantiles"] for r in quantiles.collect()}
    infinite = float("inf")
    splits = [[-infinite, *sorted(set(found.get(c) or [0.0])), infinite] for c in names]
    binned = [f"{c}__bin" for c in names]
    encoded = [f"{c}__onehot" for c in CATEGORICAL[variant]]
    return [
        Bucketizer(inputCols=names, outputCols=binned, splitsArray=splits, handleInvalid="keep"),
        VectorAssembler(inputCols=[*binned, *encoded], outputCol="tree_features"),
    ]


def codes(bins: list, prepared: PipelineModel, variant: str) -> tuple[Column, Columns]:
    """Bins and category numbers of a row in one array, and how many there are of each."""
    names = [f"{c}__bin" for c in NUMERIC[variant]] + [f"{c}__index" for c in CATEGORICAL[variant]]
    columns = Columns([len(splits) - 1 for splits in bins[0].getSplitsArray()], [len(labels) for labels in prepared.stages[0].labelsArray])
    return F.array(*[F.col(c).cast("smallint") for c in names]).alias("codes"), columns


class MeanProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Averages the late probabilities of several two-class models; above a half the prediction is late."""

    inputCols = Param(Params._dummy(), "inputCols", "probability vectors to average", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight of each", TypeConverters.toListFloat)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "mean probabilities", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class", TypeConverters.toString)

    def __init__(self, inputCols: list[str] | None = None, weights: list[float] | None = None):
        super().__init__()
        self._set(probabilityCol="probability", predictionCol="prediction")
        if inputCols is not None:
            self._set(inputCols=inputCols, weights=weights)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, names = self.getOrDefault(self.weights), self.getOrDefault(self.inputCols)
        late = F.array(*[vector_to_array(c).getItem(1) * w for c, w in zip(names, weights, strict=True)])
        made = dataset.withColumn("_p", F.aggregate(late, F.lit(0.0), lambda s, p: s + p) / sum(weights)).drop(*names)
        made = made.withColumn(self.getOrDefault(self.probabilityCol), array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        prediction = F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0)
        return made.withColumn(self.getOrDefault(self.predictionCol), prediction).drop("_p")


def _fit_forest(vectors: DataFrame, seed: int, options: dict) -> list:
    """Fitted stages of a random forest on hashed bootstrap samples of the rows."""
    options = {**dict(numTrees=200, maxDepth=12), **options}
    trees = options.pop("numTrees")
    samples = min(SAMPLES, trees)
    sizes = [trees // samples + (k < trees % samples) for k in range(samples)]
    partitions = vectors.rdd.getNumPartitions()
    at_once = samples_at_once(samples, partitions)
    vectors = vectors.coalesce(sample_partitions(vectors.count(), partitions, at_once))

    def fit(k: int):
        weighted = with_poisson_weight(vectors, k, seed).filter(F.col("weight") > 0)
        weighted = weighted.withColumn("weight", F.col("weight") * F.col("n_equal"))
        forest = RandomForestClassifier(
            featuresCol="tree_features", weightCol="weight", bootstrap=False, subsamplingRate=1.0,
            featureSubsetStrategy="sqrt", numTrees=sizes[k], seed=seed + k, cacheNodeIds=True,
            maxMemoryInMB=TREE_MEMORY_MB, probabilityCol=f"probability_{k}", predictionCol="", rawPredictionCol="", **options,
        )
        # A copy has no training summary, which would carry the training data into every scoring task.
        return forest.fit(weighted).copy()

    # Several at once, so that one's short passes fill the gaps of the others.
    with ThreadPool(at_once) as pool:
        fitted = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(samples), chunksize=1)
    return [*fitted, MeanProbability([f"probability_{k}" for k in range(samples)], [float(n) for n in sizes])]


def _without_summary(spark: SparkSession, model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model after a round trip through the shared folder.

    A freshly fitted regression still refers to its training data through its summary, and
    would carry that reference into every scoring task. Single trees and boosted ones have none.
    """
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    return LogisticRegressionModel.load(path)


def fit_model(train: DataFrame, name: str, variant: str = "A", seed: int = 42, **overrides) -> PipelineModel:
    """Preprocessing and classifier fitted on rows of ``ml_feature_table``."""
    return fit_models(train, [name], variant, seed, {name: overrides})[name]


def fit_models(
    train: DataFrame,
    names: Sequence[str] = MODELS,
    variant: str = "A",
    seed: int = 42,
    overrides: dict[str, dict] | None = None,
    partitions: int | None = None,
) -> dict[str, PipelineModel]:
    """Several classifiers on one shared preprocessing, whose output is persisted meanwhile.

    The same rows give the same trees, however they lie and whatever the number of ``partitions``
    (by ``training_partitions`` unless given); the logistic regression agrees to rounding.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    cores = spark.sparkContext.defaultParallelism
    n_rows = train.count()
    prepared = ml_preprocess(variant).fit(train)
    rows = distinct_rows_weighed(train)
    n_distinct = rows.count()
    partitions = partitions or training_partitions(n_distinct, cores)
    bins = quantile_bins(rows, variant) if set(names) - {LOGISTIC_REGRESSION} else []
    vectors = PipelineModel(stages=[*prepared.stages, *bins]).transform(rows.repartition(partitions, "place"))
    kept = ["label", "n_equal", *(["features"] if LOGISTIC_REGRESSION in names else []), *(["tree_features", "place"] if bins else [])]
    coded, columns = codes(bins, prepared, variant) if bins else (None, None)
    vectors = vectors.select(*kept, *([coded] if GRADIENT_BOOSTING in names else [])).persist(StorageLevel.MEMORY_AND_DISK)

    # Tasks start in the order of their jobs, so a forest on all cores would keep the short jobs of the others waiting.
    forest_cores = cores if set(names) == {RANDOM_FOREST} else max(cores // 2, 1)

    def fit(name: str) -> PipelineModel:
        options = (overrides or {}).get(name, {})
        if name == RANDOM_FOREST:
            stages = [*bins, *_fit_forest(vectors.coalesce(forest_partitions(n_distinct, forest_cores)), seed, options)]
        else:
            unfitted = classifier(name, n_rows, seed, **{**dict(weightCol="n_equal"), **options})
            unfitted.columns = columns
            model = unfitted.fit(vectors)
            stages = [_without_summary(spark, model)] if name == LOGISTIC_REGRESSION else [*bins, model]
        return PipelineModel(stages=[*prepared.stages, *stages])

    try:
        # All at once: the many short jobs of boosting run beside the long ones of the forest.
        with ThreadPool(max(len(names), 1)) as pool:
            return dict(zip(names, pool.map(inheritable_thread_target(spark)(fit), names, chunksize=1), strict=True))
    finally:
        vectors.unpersist()


def predict(model: PipelineModel, rows: DataFrame, name: str, keep: Sequence[str] = ("label",)) -> DataFrame:
    """``keep..., model, score, prediction``; the score is the probability of being late."""
    return model.transform(rows).select(
        *keep,
        F.lit(name).alias("model"),
        vector_to_array("probability").getItem(1).alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def ml_batch_score(model: PipelineModel, orders: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Orders with late probability (four decimals) and whether it reaches the threshold."""
    probability = vector_to_array("probability").getItem(1)
    return model.transform(orders).select(
        *orders.columns,
        F.round(probability, 4).alias("late_delivery_probability"),
        (probability >= threshold).alias("predicted_late"),
    )


def score_difference(one: PipelineModel, other: PipelineModel, rows: DataFrame) -> DataFrame:
    """``n, n_different, max_difference`` of two models' scores on the same rows, each row scored by both."""
    scored = {}
    for name, model in (("one", one), ("other", other)):
        added = [c for stage in model.stages for c in _outputs(stage)]
        base = rows if not scored else scored["one"]
        scored[name] = model.transform(base).withColumn(f"_{name}", vector_to_array("probability").getItem(1)).drop(*added)
    gap = F.abs(F.col("_one") - F.col("_other"))
    return scored["other"].agg(
        F.count("*").alias("n"), F.count_if(gap > 0).alias("n_different"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference")
    )


def _outputs(stage) -> list[str]:
    """Columns that a fitted stage adds."""
    names = ("outputCol", "outputCols", "probabilityCol", "rawPredictionCol", "predictionCol")
    values = [stage.getOrDefault(n) for n in names if stage.hasParam(n) and stage.isDefined(n)]
    return [c for v in values for c in (v if isinstance(v, list) else [v])]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_names(model: PipelineModel, variant: str = "A") -> list[str]:
    """Names of the vector slots, one-hot slots as ``column_value``."""
    names = list(NUMERIC[variant])
    labels = model.stages[0].labelsArray
    for column, values in zip(CATEGORICAL[variant], labels):
        names += [f"{column}_{value}" for value in values]
    return names


def ml_feature_importance(
    spark: SparkSession, model: PipelineModel, variant: str = "A", n: int = 15
) -> DataFrame:
    """The ``n`` most important features of a tree model."""
    found = [(s.featureImportances.toArray(), getattr(s, "getNumTrees", 1)) for s in model.stages if hasattr(s, "featureImportances")]
    importances = sum(values * trees for values, trees in found) / sum(trees for _, trees in found)
    rows = [(name, float(v)) for name, v in zip(feature_names(model, variant), importances)]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.col("importance").desc(), "feature")
        .limit(n)
        .select("feature", F.round("importance", 6).alias("importance"))
    )
