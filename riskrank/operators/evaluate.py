"""Ranking quality at a fixed review capacity, on a long score table.

The score table has one row per (model, split, entity): columns ``model``,
``split``, ``entity_id``, ``score``, ``future_aml_event``. Every metric is one
grouped aggregate over it, or over its distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.operators.joins import attach_dimension
from riskrank.operators.ranked import quantiles, running_totals, value_counts
from riskrank.operators.selection import selected_quantiles
from riskrank.schemas import ADDITIVE, LOGISTIC, SCORECARD

CAPACITY = 0.10
CALIBRATION_BINS = 10
METRICS_SHOWN = ["pr_auc", "recall_at_capacity", "precision_at_capacity"]


def score_table(scored: DataFrame, models: dict[str, str]) -> DataFrame:
    """Turn one score column per model into long rows; training rows are left out."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("score"))
        for name, column in models.items()
    ])
    return scored.filter(F.col("split") != "train").select(
        "split", "entity_id", "future_aml_event", F.inline(cells))


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Distinct scores per model with class counts and running totals."""
    positive = F.col("future_aml_event") == 1
    counts = value_counts(scores, "model", "score", {
        "pos": F.when(positive, 1).otherwise(0),
        "neg": F.when(positive, 0).otherwise(1),
        "n": F.lit(1),
    })
    return running_totals(counts, "model", "score", ["pos", "neg", "n"])


def capacity_threshold(validation_scores: DataFrame, capacity: float = CAPACITY) -> DataFrame:
    """Score above which a share ``capacity`` of the validation customers lies."""
    q = round(1.0 - capacity, 12)
    return selected_quantiles(validation_scores, "model", "score", {"threshold": q})


def capacity_metrics(test_scores: DataFrame, thresholds: DataFrame,
                     unprobabilistic: tuple[str, ...] = (SCORECARD,)) -> DataFrame:
    """Review rate, precision, recall, lift and Brier score per model."""
    flagged = F.col("score") >= F.col("threshold")
    positive = F.col("future_aml_event") == 1
    error = F.col("score") - F.col("future_aml_event")
    counted = attach_dimension(test_scores, thresholds, "model").groupBy("model").agg(
        F.max("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("positives"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & positive).alias("hits"),
        F.avg(error * error).alias("squared_error"),
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("flagged")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("positives")), F.lit(0.0))
    prevalence = F.col("positives") / F.col("n")
    return counted.select(
        "model", "threshold",
        (F.col("flagged") / F.col("n")).alias("test_review_rate"),
        precision.alias("precision_at_capacity"),
        recall.alias("recall_at_capacity"),
        F.try_divide(precision, prevalence).alias("lift_at_capacity"),
        F.when(~F.col("model").isin(*unprobabilistic), F.col("squared_error")).alias("brier_score"),
    )


def _hits_from_top() -> tuple[Column, Column]:
    """True and false positives when everything at or above a score is flagged."""
    return (F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before"))


def curve_areas(ranked: DataFrame) -> DataFrame:
    """Average precision over distinct thresholds, and ROC-AUC with ties as half."""
    tp, fp = _hits_from_top()
    precision = tp / (tp + fp)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return ranked.groupBy("model").agg(
        F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos")).alias("pr_auc"),
        F.try_divide(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"),
    )


def model_comparison(scores: DataFrame, capacity: float = CAPACITY,
                     unprobabilistic: tuple[str, ...] = (SCORECARD,)) -> DataFrame:
    """All metrics per model, best recall first. Thresholds come from validation only."""
    validation = scores.filter(F.col("split") == "validation")
    test = scores.filter(F.col("split") == "test")
    at_capacity = capacity_metrics(test, capacity_threshold(validation, capacity), unprobabilistic)
    areas = curve_areas(ranked_scores(test))
    return at_capacity.join(areas, "model").select(
        "model", "threshold", "test_review_rate", "pr_auc", "roc_auc", "precision_at_capacity",
        "recall_at_capacity", "lift_at_capacity", "brier_score",
    ).orderBy(F.desc("recall_at_capacity"), "model")


def test_predictions(scored: DataFrame) -> DataFrame:
    """Scores of all models side by side for the test customers."""
    return scored.filter(F.col("split") == "test").select(
        "entity_id", "future_aml_event", "scorecard_score", "logistic_probability",
        "ebm_probability")


def precision_recall_curve(ranked: DataFrame) -> DataFrame:
    """One point per distinct threshold plus the (precision 1, recall 0) end point."""
    tp, fp = _hits_from_top()
    points = ranked.select(
        "model", F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("pos_total")).alias("recall"),
    )
    ends = ranked.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def prevalence(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("future_aml_event").alias("prevalence"))


def probability_summary(ranked: DataFrame) -> DataFrame:
    """Range, median and upper percentiles of each model's scores."""
    inner = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    ends = ranked.groupBy("model").agg(F.min("score").alias("minimum"), F.max("score").alias("maximum"))
    chosen = selected_quantiles(ranked, "model", "score", inner, weight="n")
    return ends.join(chosen, "model").select("model", "minimum", *inner, "maximum")


def calibration(ranked: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean predicted score and observed rate per quantile bin; empty bins vanish.

    A score belongs to the bin given by the number of interior edges below it,
    so equal scores always share a bin.
    """
    inner = {f"edge_{i}": i / bins for i in range(1, bins)}
    edges = quantiles(ranked, "model", "score", "n", inner).select(
        "model", F.array(*inner).alias("edges"))
    rows = attach_dimension(ranked, edges, "model")
    place = F.size(F.filter("edges", lambda edge: edge < F.col("score")))
    return (
        rows.withColumn("bin", place).groupBy("model", "bin")
        .agg(F.sum("n").alias("customers"),
             (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
             (F.sum("pos") / F.sum("n")).alias("observed_rate"))
    )


def metric_chart(comparison: DataFrame, metrics: list[str] = METRICS_SHOWN) -> DataFrame:
    """Comparison metrics as (model, metric, value) rows."""
    return comparison.unpivot(["model"], metrics, "metric", "value")


ALL_MODELS = {
    SCORECARD: "scorecard_score", LOGISTIC: "logistic_probability", ADDITIVE: "ebm_probability"}
