"""Two-sample rank tests, contingency tests and effect sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.maths import chi_square_tail, normal_two_sided
from riskrank.operators.ranked import quantile_columns, running_totals, value_counts
from riskrank.operators.joins import attach_dimension
from riskrank.schemas import TESTED_CATEGORICAL, TESTED_NUMERIC
from riskrank.session import materialise


def median_comparison(features: DataFrame, columns: list[str] = TESTED_NUMERIC,
                      label: str = "future_aml_event") -> DataFrame:
    """Approximate medians (an actual element each) per outcome."""
    medians = [F.percentile_approx(c, 0.5).alias(f"median_{c}") for c in columns]
    return features.groupBy(label).agg(*medians).orderBy(label)


def ranked_features(features: DataFrame, columns: list[str] = TESTED_NUMERIC,
                    label: str = "future_aml_event") -> DataFrame:
    """Distinct values of every feature with class counts and running class counts."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])
    long = features.select(F.col(label).alias("y"), F.inline(cells)).filter(
        F.col("value").isNotNull() & ~F.isnan("value") & F.col("y").isNotNull())
    counts = value_counts(long, "feature", "value", {
        "pos": F.when(F.col("y") == 1, 1).otherwise(0),
        "neg": F.when(F.col("y") == 0, 1).otherwise(0),
    })
    return running_totals(counts, "feature", "value", ["pos", "neg"])


def rank_columns() -> list[Column]:
    """Aggregates over ranked rows: class sizes, Mann-Whitney U of positives, tie term."""
    ties = (F.col("pos") + F.col("neg")).cast("double")
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return [
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(wins).alias("u_statistic"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
    ]


def _asymptotic_p(u: Column, n_pos: Column, n_neg: Column, tie_term: Column) -> Column:
    """Two-sided p by the normal approximation with tie and continuity correction.

    Identical values everywhere carry no evidence (p = 1); an empty class
    leaves the test undefined (NULL).
    """
    product = n_pos.cast("double") * n_neg
    n = (n_pos + n_neg).cast("double")
    tie_share = F.try_divide(tie_term, n * (n - 1))
    variance = product / 12.0 * (n + 1 - tie_share)
    z = F.try_divide(F.greatest(u, product - u) - product / 2.0 - 0.5, F.sqrt(variance))
    return F.when(variance > 0, normal_two_sided(z)).when(product > 0, F.lit(1.0))


def effect_label(effect: Column) -> Column:
    size = F.abs(effect)
    return (
        F.when(size < 0.10, "negligible").when(size < 0.30, "small")
        .when(size <= 0.50, "moderate").otherwise("strong")
    )


def numeric_tests(features: DataFrame, columns: list[str] = TESTED_NUMERIC,
                  label: str = "future_aml_event") -> DataFrame:
    """Mann-Whitney test, exact class medians and rank-biserial effect per feature.

    Test and medians come from one aggregate over the ranked values. Strongest
    effect first.
    """
    tested = ranked_features(features, columns, label).groupBy("feature").agg(
        *rank_columns(),
        *quantile_columns("value", "pos", {"positive_median": 0.5}),
        *quantile_columns("value", "neg", {"negative_median": 0.5}))
    effect = F.try_divide(
        F.col("u_statistic") * 2.0, F.col("n_pos").cast("double") * F.col("n_neg")) - 1
    p = _asymptotic_p(*[F.col(c) for c in ("u_statistic", "n_pos", "n_neg", "tie_term")])
    return (
        tested.select("feature", "positive_median", "negative_median", p.alias("p_value"),
                      effect.alias("rank_biserial_effect"))
        .withColumn("adjusted_p_value", F.least(F.col("p_value") * len(columns), F.lit(1.0)))
        .withColumn("absolute_effect", F.abs("rank_biserial_effect"))
        .orderBy(F.desc("absolute_effect"), "feature")
    )


def contingency(features: DataFrame, columns: list[str] = TESTED_CATEGORICAL,
                label: str = "future_aml_event") -> DataFrame:
    """Counts per (feature, level) and outcome, all features in one pass."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"))
        for c in columns
    ])
    return (
        features.select(F.col(label).alias("y"), F.inline(cells)).dropna(subset=["level", "y"])
        .groupBy("feature", "level")
        .agg(F.count_if(F.col("y") == 0).alias("negatives"),
             F.count_if(F.col("y") == 1).alias("positives"))
    )


def chi_square_from_counts(table: DataFrame) -> DataFrame:
    """Chi-square independence test and Cramer's V per feature of a contingency table.

    A 2 x 2 table gets the continuity correction, bounded so that a cell is
    never moved past its expectation. Margins are grouped and attached, so a
    feature with many levels is not gathered in one task.
    """
    stored = materialise(table, "contingency")
    by_feature = stored.groupBy("feature").agg(
        *[F.sum(c).cast("double").alias(f"all_{c}") for c in ("negatives", "positives")],
        F.count(F.lit(1)).alias("levels"))
    margins = attach_dimension(stored, by_feature, "feature").withColumns({
        "row_sum": (F.col("negatives") + F.col("positives")).cast("double"),
        "n": F.col("all_negatives") + F.col("all_positives"),
    })
    classes = sum((F.when(F.col(f"all_{c}") > 0, 1).otherwise(0)
                   for c in ("negatives", "positives")), F.lit(0))
    dof = (F.col("levels") - 1) * (classes - 1)
    cell_terms = F.lit(0.0)
    for c in ("negatives", "positives"):
        expected = F.col("row_sum") * F.col(f"all_{c}") / F.col("n")
        gap = F.abs(F.col(c) - expected)
        moved = gap - F.when(F.col("dof") == 1, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
        cell_terms = cell_terms + F.when(expected > 0, moved * moved / expected).otherwise(0.0)
    tested = margins.withColumn("dof", dof).groupBy("feature").agg(
        F.when(F.max("dof") > 0, F.sum(cell_terms)).otherwise(F.lit(0.0)).alias("chi_square"),
        F.max("dof").alias("dof"),
        F.max("n").alias("n"),
        F.max(F.least(F.col("levels") - 1, classes - 1)).alias("smaller_side"),
    )
    strength = F.when(
        F.col("smaller_side") > 0,
        F.sqrt(F.col("chi_square") / (F.col("n") * F.col("smaller_side"))),
    ).otherwise(F.lit(0.0))
    return tested.select(
        "feature", "chi_square",
        chi_square_tail(F.col("chi_square"), F.col("dof")).alias("p_value"),
        strength.alias("cramers_v"),
    ).orderBy(F.desc("cramers_v"), "feature")


def categorical_tests(features: DataFrame, columns: list[str] = TESTED_CATEGORICAL,
                      label: str = "future_aml_event") -> DataFrame:
    return chi_square_from_counts(contingency(features, columns, label))
