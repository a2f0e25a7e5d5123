"""Classifier metrics from predictions ``(model, label, prediction, score)``.

All metrics are aggregates per model. Curves are built on counts per distinct score with
running sums that are split over tasks, so neither a model's predictions nor its distinct
scores are ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_when
from ..functions.ordered import running_sums


def _positive() -> Column:
    return F.col("label") == 1


def _predicted() -> Column:
    return F.col("prediction") == 1


def ml_fixed_score(fact: DataFrame) -> DataFrame:
    """A rule-based score, to check the metrics without a trained model."""
    score = (4 - F.col("days_for_shipment_scheduled")) * 100 + F.col("order_item_quantity")
    return fact.select(
        F.lit("fixed_rule").alias("model"),
        F.col("late_delivery_risk").cast("int").alias("label"),
        score.cast("bigint").alias("score"),
        (score >= 150).cast("int").alias("prediction"),
    )


def _counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(
        count_when(_positive() & _predicted()).alias("tp"),
        count_when(~_positive() & _predicted()).alias("fp"),
        count_when(_positive() & ~_predicted()).alias("fn"),
        count_when(~_positive() & ~_predicted()).alias("tn"),
    )


def _rate(part: Column, whole: Column) -> Column:
    """part / whole, zero when whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _threshold_metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": F.round(_rate(tp + tn, tp + fp + fn + tn), 4),
        "precision": F.round(_rate(tp, tp + fp), 4),
        "recall": F.round(_rate(tp, tp + fn), 4),
        "f1_score": F.round(_rate(2 * tp, 2 * tp + fp + fn), 4),
    }


def ml_majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics of always predicting the most frequent training label (0 on a tie)."""
    majority = train.agg(F.when(F.sum("label") * 2 > F.count("*"), 1).otherwise(0)).scalar()
    counts = test.agg(
        F.coalesce(F.sum(_positive().cast("bigint")), F.lit(0)).alias("p"), F.count("*").alias("n")
    ).withColumn("m", majority)
    return (
        counts.select(
            F.lit("majority_class").alias("model"),
            F.when(F.col("m") == 1, F.col("p")).otherwise(0).alias("tp"),
            F.when(F.col("m") == 1, F.col("n") - F.col("p")).otherwise(0).alias("fp"),
            F.when(F.col("m") == 1, 0).otherwise(F.col("p")).alias("fn"),
            F.when(F.col("m") == 1, 0).otherwise(F.col("n") - F.col("p")).alias("tn"),
        )
        .select("model", *[value.alias(name) for name, value in _threshold_metrics().items()])
    )


def _by_score(predictions: DataFrame) -> DataFrame:
    """Positives and negatives per model and distinct score."""
    return predictions.groupBy("model", "score").agg(
        count_when(_positive()).alias("pos"), count_when(~_positive()).alias("neg")
    )


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Exact area under the ROC curve per model; tied scores count one half."""
    above = running_sums(_by_score(predictions), "score", ["pos"], ["model"], descending=True)
    won = F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2.0)
    return above.groupBy("model").agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    )


def ml_metrics(predictions: DataFrame) -> DataFrame:
    """``model, metric, value``: accuracy, precision, recall, F1 and ROC-AUC."""
    rates = _counts(predictions).select(
        "model", *[value.alias(name) for name, value in _threshold_metrics().items()]
    )
    at_threshold = rates.select(
        "model",
        F.expr(
            "stack(4, 'accuracy', accuracy, 'precision', precision, 'recall', recall, 'f1_score', f1_score)"
            " AS (metric, value)"
        ),
    )
    auc = roc_auc(predictions).select("model", F.lit("roc_auc").alias("metric"), F.round("auc", 4).alias("value"))
    return at_threshold.unionByName(auc)


def ml_confusion_matrix(predictions: DataFrame) -> DataFrame:
    """All four cells per model, empty ones as zero."""
    return _counts(predictions).select(
        "model",
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, n)"),
    )


def ml_roc_curve(predictions: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score, as threshold from above."""

    def rate(side: str) -> Column:
        return F.round(F.try_divide(F.col(f"{side}_before") + F.col(side), F.col(f"{side}_total")), 6)

    return running_sums(_by_score(predictions), "score", ["pos", "neg"], ["model"], descending=True).select(
        "model", F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr")
    )


def ml_classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def of_class(name: str, hit: Column, false: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            _rate(hit, hit + false).alias("precision"),
            _rate(hit, hit + missed).alias("recall"),
            _rate(2 * hit, 2 * hit + false + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    base = _counts(predictions).select("model", of_class("0", tn, fn, fp).alias("c0"), of_class("1", tp, fp, fn).alias("c1"))
    n = F.col("c0.support") + F.col("c1.support")

    def average(name: str, weighted: bool) -> Column:
        def mean(metric: str) -> Column:
            a, b = F.col(f"c0.{metric}"), F.col(f"c1.{metric}")
            if not weighted:
                return (a + b) / 2
            return F.try_divide(a * F.col("c0.support") + b * F.col("c1.support"), n)

        return F.struct(
            F.lit(name).alias("class"),
            *[mean(m).alias(m) for m in ("precision", "recall", "f1_score")],
            n.alias("support"),
        )

    rows = F.array(F.col("c0"), F.col("c1"), average("macro avg", False), average("weighted avg", True))
    return base.select("model", F.explode(rows).alias("r")).select(
        "model",
        "r.class",
        *[F.round(f"r.{m}", 4).alias(m) for m in ("precision", "recall", "f1_score")],
        F.col("r.support").alias("support"),
    )


def ml_best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest ROC-AUC (first name on a tie)."""
    auc = metrics.filter(F.col("metric") == "roc_auc")
    best = F.min_by(F.struct("model", "value"), F.struct(-F.col("value"), F.col("model"))).alias("best")
    return auc.agg(best).select(F.col("best.model").alias("best_model"), F.col("best.value").alias("roc_auc"))
