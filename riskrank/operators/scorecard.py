"""Points scorecard with rating bands and reason codes, all driven by one rule list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.operators.counting import share_of_total

# Factor, points column, and per scored value its points and reason code.
RULES = [
    ("country_risk", "country_points",
     {"High": (20, "HIGH_RISK_COUNTRY"), "Medium": (8, "MEDIUM_RISK_COUNTRY")}),
    ("pep_status", "pep_points",
     {"Direct": (25, "DIRECT_PEP"), "Associate": (15, "PEP_ASSOCIATE")}),
    ("ubo_complexity", "ubo_points",
     {"Complex": (20, "COMPLEX_UBO_STRUCTURE"), "Moderate": (8, "MODERATE_UBO_COMPLEXITY")}),
    ("industry_risk", "industry_points",
     {"Cash Intensive": (15, "CASH_INTENSIVE_INDUSTRY"), "Elevated": (7, "ELEVATED_INDUSTRY_RISK")}),
    ("onboarding_channel", "channel_points", {"Remote": (5, "REMOTE_ONBOARDING")}),
    ("kyc_documentation", "documentation_points",
     {"Incomplete": (15, "INCOMPLETE_KYC_DOCUMENTATION")}),
]

# Rating bands, highest first, by lowest score.
BANDS = [("HIGH", 35), ("MEDIUM", 15), ("LOW", 0)]


def _lookup(factor: str, outcome: dict[str, Column], default: Column) -> Column:
    picked = default
    for value, result in outcome.items():
        picked = F.when(F.col(factor) == value, result).otherwise(picked)
    return picked


def rating(score: Column, bands=BANDS) -> Column:
    label = F.lit(bands[-1][0])
    for name, floor in reversed(bands[:-1]):
        label = F.when(score >= floor, name).otherwise(label)
    return label


def score_customers(profiles: DataFrame, rules=RULES, bands=BANDS) -> DataFrame:
    """Add points per factor, the total, its band and the ordered reason codes."""
    points = {
        column: _lookup(factor, {v: F.lit(p) for v, (p, _) in values.items()}, F.lit(0))
        for factor, column, values in rules
    }
    total = sum((F.col(c) for c in points), F.lit(0))
    reasons = F.array(*[
        _lookup(factor, {v: F.lit(code) for v, (_, code) in values.items()},
                F.lit(None).cast("string"))
        for factor, _, values in rules
    ])
    return (
        profiles.withColumns(points)
        .withColumn("kyc_risk_score", total)
        .withColumns({
            "kyc_risk_rating": rating(F.col("kyc_risk_score"), bands),
            "reason_codes": F.array_compact(reasons),
        })
    )


def _band_order(bands=BANDS) -> Column:
    names = F.array(*[F.lit(name) for name, _ in reversed(bands)])
    return F.array_position(names, F.col("kyc_risk_rating"))


def rating_distribution(scored: DataFrame) -> DataFrame:
    """Customers, average score and share per rating, lowest band first."""
    grouped = scored.groupBy("kyc_risk_rating").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("kyc_risk_score"), 2).alias("average_score"),
    )
    return share_of_total(grouped, 2, "customers").orderBy(_band_order())


def rating_outcomes(scored: DataFrame) -> DataFrame:
    """Back-test: how often each rating was followed by a positive outcome."""
    grouped = scored.groupBy("kyc_risk_rating").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("future_aml_event").alias("future_positive_customers"),
        F.round(F.avg("future_aml_event") * 100, 4).alias("future_positive_rate"),
    )
    return grouped.orderBy(_band_order())


def top_high_risk(scored: DataFrame, rows: int = 20) -> DataFrame:
    """The highest scores of the HIGH band; ties go by entity id."""
    shown = ["entity_id", "entity_name", "customer_type", "kyc_risk_score", "kyc_risk_rating",
             "reason_codes", "future_aml_event"]
    return (
        scored.filter(F.col("kyc_risk_rating") == "HIGH").select(*shown)
        .orderBy(F.desc("kyc_risk_score"), "entity_id").limit(rows)
    )
