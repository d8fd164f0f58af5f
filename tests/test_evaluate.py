import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.operators import decide, evaluate
from riskrank.schemas import ADDITIVE, LOGISTIC, SCORECARD

TEN = [.1, .2, .2, .3, .4, .5, .6, .7, .8, .9]
LABELS = [0, 0, 0, 0, 1, 0, 1, 0, 1, 1]


def scores(spark, values, labels, model="m", split="test"):
    return spark.createDataFrame(
        [(model, split, f"E{i}", s, y) for i, (s, y) in enumerate(zip(values, labels))],
        "model string, split string, entity_id string, score double, future_aml_event int")


def test_threshold_is_interpolated(spark):
    got = evaluate.capacity_threshold(scores(spark, TEN, LABELS)).first()
    assert got.threshold == pytest.approx(0.81)


def test_areas_known_answer(spark):
    row = evaluate.curve_areas(evaluate.ranked_scores(
        scores(spark, [.9, .8, .7, .6], [1, 0, 1, 0]))).first()
    assert row.pr_auc == pytest.approx(0.833333, abs=1e-6) and row.roc_auc == 0.75


def test_areas_with_many_ties_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + 0.3 * y, 1)
    pos, neg = s[y == 1], s[y == 0]
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    ap, reached = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        flagged = s >= t
        recall = y[flagged].sum() / y.sum()
        ap += (recall - reached) * y[flagged].mean()
        reached = recall
    row = evaluate.curve_areas(evaluate.ranked_scores(
        scores(spark, s.tolist(), y.tolist()))).first()
    assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)


def test_capacity_metrics(spark):
    test = scores(spark, TEN, LABELS).unionByName(scores(spark, TEN, LABELS, SCORECARD))
    cut = spark.createDataFrame([("m", 0.8), (SCORECARD, 2.0)], "model string, threshold double")
    row = {r.model: r for r in evaluate.capacity_metrics(test, cut).collect()}
    assert row["m"].test_review_rate == 0.2 and row["m"].precision_at_capacity == 1.0
    assert row["m"].recall_at_capacity == 0.5 and row["m"].lift_at_capacity == 2.5
    brier = np.mean((np.array(TEN) - np.array(LABELS)) ** 2)
    assert row["m"].brier_score == pytest.approx(brier)
    none = row[SCORECARD]
    assert (none.precision_at_capacity, none.recall_at_capacity, none.brier_score) == (0.0, 0.0, None)


def test_no_positives_leaves_lift_undefined(spark):
    cut = spark.createDataFrame([("m", 0.5)], "model string, threshold double")
    row = evaluate.capacity_metrics(scores(spark, [.4, .6], [0, 0]), cut).first()
    assert (row.precision_at_capacity, row.recall_at_capacity, row.lift_at_capacity) == (0, 0, None)


def test_curve_ends_at_precision_one(spark, rows):
    curve = evaluate.precision_recall_curve(evaluate.ranked_scores(
        scores(spark, [.9, .8, .7, .6], [1, 0, 1, 0])))
    points = rows(curve, "threshold", "precision", "recall")
    assert (None, 1.0, 0.0) in points and (0.6, 0.5, 1.0) in points and len(points) == 5


def test_calibration_known_answer(spark):
    got = evaluate.calibration(evaluate.ranked_scores(scores(spark, TEN, LABELS)), bins=5)
    pairs = [(r.mean_predicted, r.observed_rate) for r in got.orderBy("bin").collect()]
    wanted = [(.166667, 0), (.3, 0), (.45, .5), (.65, .5), (.85, 1)]
    assert np.allclose(pairs, wanted, atol=1e-6)


def test_equal_scores_share_a_bin(spark):
    got = evaluate.calibration(evaluate.ranked_scores(scores(spark, [.3] * 20, [0, 1] * 10)))
    assert [(r.customers, r.observed_rate) for r in got.collect()] == [(20, 0.5)]


def test_summary_and_chart(spark, rows):
    row = evaluate.probability_summary(evaluate.ranked_scores(scores(spark, TEN, LABELS))).first()
    assert (row.minimum, row.median, row.maximum) == (0.1, pytest.approx(0.45), 0.9)
    assert row.p95 == pytest.approx(np.quantile(TEN, .95))
    comparison = evaluate.model_comparison(scores(spark, TEN, LABELS).unionByName(
        scores(spark, TEN, LABELS, split="validation")))
    assert {r[1] for r in rows(evaluate.metric_chart(comparison))} == set(evaluate.METRICS_SHOWN)


def test_threshold_comes_from_validation_only(spark):
    both = scores(spark, TEN, LABELS).unionByName(
        scores(spark, [v / 2 for v in TEN], LABELS, split="validation"))
    assert evaluate.model_comparison(both).first().threshold == pytest.approx(0.405)


@pytest.mark.parametrize("challenger,champion", [
    ((0.3299 + 0.0131, 0.09285 + 0.00076, 0.010897), LOGISTIC),
    ((0.40, 0.12, 0.0110), ADDITIVE),
    ((0.40, 0.10, 0.0110), LOGISTIC),
    ((0.40, 0.12, 0.0130), LOGISTIC),
])
def test_champion_rule(spark, challenger, champion):
    comparison = spark.createDataFrame(
        [(LOGISTIC, 0.3299, 0.09285, 0.010879), (ADDITIVE, *challenger)],
        "model string, recall_at_capacity double, pr_auc double, brier_score double")
    row = decide.champion_decision(comparison).first()
    assert row.champion == champion
    assert row.decision_reason == (
        decide.REASON_CHALLENGER if champion == ADDITIVE else decide.REASON_INCUMBENT)


def test_score_table_leaves_training_rows_out(spark):
    frame = spark.createDataFrame(
        [("E1", 1, "train", .5), ("E2", 0, "test", .4)],
        "entity_id string, future_aml_event int, split string, s double")
    got = evaluate.score_table(frame, {"m": "s"}).collect()
    assert [(r.entity_id, r.model, r.score) for r in got] == [("E2", "m", .4)]


def test_prevalence(spark):
    assert evaluate.prevalence(scores(spark, TEN, LABELS)).select(
        F.round("prevalence", 6)).first()[0] == 0.4
