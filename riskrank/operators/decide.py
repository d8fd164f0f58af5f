"""Predeclared champion rule between the simple model and its challenger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.schemas import ADDITIVE, LOGISTIC

# The gates and the two published reasons.
MIN_RECALL_GAIN = 0.05
MIN_PR_AUC_GAIN = 0.02
MAX_BRIER_RATIO = 1.10
REASON_CHALLENGER = (
    "EBM provides material performance improvement while retaining acceptable calibration "
    "and intrinsic interpretability."
)
REASON_INCUMBENT = (
    "EBM does not provide enough additional value to justify its greater modelling and "
    "validation complexity."
)


def champion_decision(comparison: DataFrame, incumbent: str = LOGISTIC,
                      challenger: str = ADDITIVE) -> DataFrame:
    """One row: metric gains, the three gates, the champion and the reason."""
    def metric(model: str, name: str):
        return F.max(F.when(F.col("model") == model, F.col(name)))

    gains = comparison.agg(
        (metric(challenger, "recall_at_capacity") - metric(incumbent, "recall_at_capacity"))
        .alias("recall_improvement"),
        (metric(challenger, "pr_auc") - metric(incumbent, "pr_auc")).alias("pr_auc_improvement"),
        (metric(challenger, "brier_score") <= metric(incumbent, "brier_score") * MAX_BRIER_RATIO)
        .alias("calibration_acceptable"),
    )
    wins = F.coalesce(
        (F.col("recall_improvement") >= MIN_RECALL_GAIN)
        & (F.col("pr_auc_improvement") >= MIN_PR_AUC_GAIN)
        & F.col("calibration_acceptable"), F.lit(False))
    return gains.withColumns({
        "champion": F.when(wins, challenger).otherwise(incumbent),
        "decision_reason": F.when(wins, REASON_CHALLENGER).otherwise(REASON_INCUMBENT),
    })
