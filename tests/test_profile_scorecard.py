import pytest
from pyspark.sql import functions as F

from riskrank.operators import profile, scorecard

CASES = [
    ("High", "Direct", "Complex", "Cash Intensive", "Remote", "Incomplete", 100, "HIGH",
     ["HIGH_RISK_COUNTRY", "DIRECT_PEP", "COMPLEX_UBO_STRUCTURE", "CASH_INTENSIVE_INDUSTRY",
      "REMOTE_ONBOARDING", "INCOMPLETE_KYC_DOCUMENTATION"]),
    ("Medium", "None", "Moderate", "Standard", "Branch", "Complete", 16, "MEDIUM",
     ["MEDIUM_RISK_COUNTRY", "MODERATE_UBO_COMPLEXITY"]),
    ("Low", "None", "Simple", "Standard", "Branch", "Complete", 0, "LOW", []),
    ("Low", "Associate", "Simple", "Elevated", "Remote", "Complete", 27, "MEDIUM",
     ["PEP_ASSOCIATE", "ELEVATED_INDUSTRY_RISK", "REMOTE_ONBOARDING"]),
]
FACTORS = [rule[0] for rule in scorecard.RULES]


@pytest.mark.parametrize("case", CASES)
def test_points_rating_and_reasons(spark, case):
    frame = spark.createDataFrame([case[:6]], ", ".join(f"{c} string" for c in FACTORS))
    row = scorecard.score_customers(frame).first()
    assert (row.kyc_risk_score, row.kyc_risk_rating, row.reason_codes) == case[6:]


def test_missing_factor_scores_zero(spark):
    frame = spark.createDataFrame([(None,) * 6], ", ".join(f"{c} string" for c in FACTORS))
    row = scorecard.score_customers(frame).first()
    assert (row.kyc_risk_score, row.kyc_risk_rating, row.reason_codes) == (0, "LOW", [])


def test_rating_bounds(spark):
    frame = spark.createDataFrame([(s,) for s in (14, 15, 34, 35)], "s int")
    got = [r[0] for r in frame.select(scorecard.rating(F.col("s"))).collect()]
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_distributions_run_from_low_to_high(spark):
    frame = spark.createDataFrame(
        [("HIGH", 40, 1), ("LOW", 0, 0), ("LOW", 5, 1), ("MEDIUM", 15, 0)],
        "kyc_risk_rating string, kyc_risk_score int, future_aml_event int")
    assert [tuple(r) for r in scorecard.rating_distribution(frame).collect()] == [
        ("LOW", 2, 2.5, 50.0), ("MEDIUM", 1, 15.0, 25.0), ("HIGH", 1, 40.0, 25.0)]
    assert [tuple(r) for r in scorecard.rating_outcomes(frame).collect()] == [
        ("LOW", 2, 1, 50.0), ("MEDIUM", 1, 0, 0.0), ("HIGH", 1, 1, 100.0)]


def test_customer_type_first_match_wins(spark):
    names = ["Corporation Partnership #1", "Sole Proprietorship #2", "Individual #3", None]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, entity_name string")
    got = [r[0] for r in frame.orderBy("i").select(profile.customer_type(F.col("entity_name"))).collect()]
    assert got == ["Corporation", "Sole Proprietorship", "Other", "Other"]


@pytest.mark.parametrize("algo", ["xxhash64", "md5"])
def test_assigned_shares_are_near_nominal_and_reproducible(spark, algo):
    n = 20_000
    people = spark.range(n).select(F.concat(F.lit("E"), "id").alias("entity_id"))
    assigned = profile.assign_attributes(people, algo=algo)
    counts = {(r.attribute, r.value): r["count"]
              for r in profile.attribute_distribution(assigned, list(profile.ASSIGNED)).collect()}
    for attribute, (_, shares) in profile.ASSIGNED.items():
        for label, share in shares:
            p = share / 100
            assert abs(counts[attribute, label] - n * p) < 4 * (n * p * (1 - p)) ** 0.5
    again = profile.assign_attributes(people.repartition(5), algo=algo)
    assert assigned.exceptAll(again).isEmpty()


def test_attribute_percentages_sum_to_hundred(spark):
    people = spark.range(300).select(F.concat(F.lit("E"), "id").alias("entity_id"))
    table = profile.attribute_distribution(
        profile.assign_attributes(people), list(profile.ASSIGNED))
    sums = table.groupBy("attribute").agg(F.sum("percentage")).collect()
    assert all(abs(r[1] - 100) < 0.05 for r in sums)
