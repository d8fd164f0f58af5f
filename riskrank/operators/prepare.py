"""Model inputs: bounded transforms, fills and a reproducible stratified split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.functions.keys import hash_number
from riskrank.functions.maths import clip, finite_or
from riskrank.operators.joins import attach_dimension
from riskrank.operators.selection import select_ranks
from riskrank.schemas import MODEL_NUMERIC, PROFILE_ATTRIBUTES, TESTED_NUMERIC, UNBOUNDED

SEED = 42
SPLIT_SHARES = [("train", 0.6), ("validation", 0.2), ("test", 0.2)]
ZSCORE_RANGE = (-5.0, 10.0)
UNKNOWN = "Unknown"


def model_frame(features: DataFrame, label: str = "future_aml_event") -> DataFrame:
    """Entity, outcome, scorecard score and the nineteen model inputs.

    The scorecard score is carried for comparison only; neither it nor the
    rating is a model input.
    """
    numeric = []
    for source, name in zip(TESTED_NUMERIC, MODEL_NUMERIC):
        value = F.col(source).cast("double")
        if source in UNBOUNDED:
            value = F.log1p(F.greatest(value, F.lit(0.0)))
        elif source == "maximum_amount_zscore":
            value = clip(value, *ZSCORE_RANGE)
        numeric.append(finite_or(value, 0.0).alias(name))
    nominal = [F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in PROFILE_ATTRIBUTES]
    baseline = (F.col("kyc_risk_score") / 100.0).alias("scorecard_score")
    return features.select(
        "entity_id", F.col(label).cast("int").alias("future_aml_event"), baseline,
        *numeric, *nominal)


def stratified_split(frame: DataFrame, key: str = "entity_id", label: str = "future_aml_event",
                     seed: int = SEED, algo: str = "xxhash64", shares=SPLIT_SHARES) -> DataFrame:
    """Add a ``split`` column with the same shares inside every class.

    Rows are ordered by a seeded hash of their key and each class is cut at
    exact ranks, so membership does not depend on partitioning or row order.
    Rows without a label belong to no class and get the split ``unlabelled``.
    """
    hashed = frame.withColumn("_draw", hash_number(key, seed, algo))
    positions, reached = {}, 0.0
    for i, (_, part) in enumerate(shares[:-1]):
        reached = round(reached + part, 9)
        # The last draw within the share; equal draws stay together.
        positions[f"_edge_{i}"] = lambda total, share=reached: F.ceil(total * F.lit(share)) - 1
    edges = select_ranks(hashed, label, "_draw", positions)
    # Two cut points per class come back, so the frame itself is never shuffled.
    placed = attach_dimension(hashed, edges, label)
    picked = F.lit(shares[-1][0])
    for i in reversed(range(len(positions))):
        picked = F.when(F.col("_draw") <= F.col(f"_edge_{i}"), shares[i][0]).otherwise(picked)
    picked = F.when(F.col(label).isNull(), "unlabelled").otherwise(picked)
    return placed.withColumn("split", picked).select(*frame.columns, "split")


def split_summary(split: DataFrame, label: str = "future_aml_event") -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(label).alias("positives"))
