"""Customer profile: account roll-up, legal form and hash-assigned attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.keys import hash_bucket, weighted_label
from riskrank.operators.mapping import entity_rollup
from riskrank.schemas import PROFILE_ATTRIBUTES

# Legal forms looked for in the entity name, first match wins.
LEGAL_FORMS = ["Corporation", "Partnership", "Sole Proprietorship"]

# Seed and percentage shares of each assigned attribute.
ASSIGNED = {
    "country_risk": (101, [("Low", 75), ("Medium", 20), ("High", 5)]),
    "pep_status": (202, [("None", 97), ("Associate", 2), ("Direct", 1)]),
    "ubo_complexity": (303, [("Simple", 70), ("Moderate", 22), ("Complex", 8)]),
    "industry_risk": (404, [("Standard", 65), ("Elevated", 25), ("Cash Intensive", 10)]),
    "onboarding_channel": (505, [("Branch", 70), ("Remote", 30)]),
    "kyc_documentation": (606, [("Complete", 92), ("Incomplete", 8)]),
}


def customer_type(name: Column) -> Column:
    found = [F.when(name.contains(form), form) for form in LEGAL_FORMS]
    return F.coalesce(*found, F.lit("Other"))


def profile_base(accounts: DataFrame, target: DataFrame) -> DataFrame:
    """Account roll-up restricted to the modelling population, with its outcome."""
    outcome = target.select("entity_id", "future_aml_event")
    return entity_rollup(accounts).join(outcome, "entity_id")


def assign_attributes(df: DataFrame, key: str = "entity_id", algo: str = "xxhash64",
                      assigned: dict | None = None) -> DataFrame:
    """Add reproducible attributes: the same key always receives the same labels."""
    rules = ASSIGNED if assigned is None else assigned
    return df.withColumns({
        name: weighted_label(hash_bucket(key, seed, sum(s for _, s in shares), algo), shares)
        for name, (seed, shares) in rules.items()
    })


def customer_profiles(accounts: DataFrame, target: DataFrame, algo: str = "xxhash64") -> DataFrame:
    base = profile_base(accounts, target)
    return assign_attributes(
        base.withColumn("customer_type", customer_type(F.col("entity_name"))), algo=algo)


def attribute_distribution(profiles: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Customers and share per attribute value, all attributes in one pass."""
    columns = attributes or PROFILE_ATTRIBUTES
    cells = F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in columns])
    counts = profiles.select(F.inline(cells)).groupBy("attribute", "value").count()
    # Every customer has one cell per attribute, so all attributes share one total.
    total = counts.agg(F.sum("count") / len(columns)).scalar()
    return counts.withColumn(
        "percentage", F.round(F.try_divide(F.col("count"), total) * 100, 2)
    ).orderBy("attribute", F.desc("count"), "value")


def type_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("customer_type").count().orderBy(F.desc("count"), "customer_type")
