import pytest
from pyspark.sql import functions as F

from riskrank.operators import audit, counting, mapping, temporal
from riskrank.schemas import ACC_RAW, TX_RAW


@pytest.fixture(scope="module")
def raw(spark):
    accounts = spark.createDataFrame([
        ("Bank A", "001", " a1 ", "E1", "Corporation #1"),
        ("Bank A", "1", "A1", "E1", "Corporation #1"),
        ("Bank B", "02", "b1", "E2", "Partnership #2"),
        ("Bank X", "X9 ", "x1", "E3", "Individual #3"),
    ], ACC_RAW)
    transactions = spark.createDataFrame([
        ("2022/09/01 00:20", "0001", "a1", "2", "B1", 5.0, "USD", 6.0, " EUR ", "Wire", 0),
        ("2022/09/02 10:00", "2", "b1", "X9", "X1", 7.0, "USD", None, "USD", "Cash", 1),
        ("not a time", "7", "zz", "1", "A1", 7.0, "USD", 1.0, "USD", "Cash", 0),
        ("2022/09/09 10:00", None, "a1", "1", "A1", 7.0, "USD", 1.0, "USD", "Cash", 1),
    ], TX_RAW)
    return accounts, transactions


@pytest.fixture(scope="module")
def enriched(raw):
    accounts = mapping.customer_accounts(raw[0])
    return mapping.enrich_transactions(mapping.clean_transactions(raw[1]), accounts)


def test_label_and_time_columns(raw, spark):
    assert audit.find_label_column(raw[1]) == "Is Laundering"
    assert audit.find_time_column(raw[1]) == "Timestamp"
    assert audit.find_time_column(raw[0]) is None
    with pytest.raises(ValueError, match="is_laundering"):
        audit.find_label_column(raw[0])


def test_audit_tables(raw, rows):
    accounts, transactions = raw
    assert rows(audit.row_counts({"t": transactions, "a": accounts})) == [("a", 4), ("t", 4)]
    assert rows(audit.label_distribution(transactions)) == [(0, 2, 50.0), (1, 2, 50.0)]
    nulls = dict(rows(audit.null_counts_long(transactions)))
    assert nulls["Amount Paid"] == 1 and nulls["From Bank"] == 1 and nulls["Timestamp"] == 0
    record = audit.audit_record("x", transactions, accounts).first()
    assert (record.transaction_rows, record.account_rows, record.transaction_columns) == (4, 4, 11)


def test_ambiguity_gate(spark):
    frame = spark.createDataFrame(
        [(1, "A", "E1"), (1, "A", "E2"), (1, "A", "E2"), (2, "A", "E1")], "b int, a string, e string")
    assert [tuple(r) for r in mapping.ambiguous_keys(frame, ["b", "a"], "e").collect()] == [
        (1, "A", 2, 3)]
    with pytest.raises(ValueError, match="conflicting"):
        mapping.assert_unique_mapping(frame, ["b", "a"], "e")
    mapping.assert_unique_mapping(frame.filter("e = 'E1'"), ["b", "a"], "e")


def test_accounts_are_canonical_and_unique(raw, rows):
    accounts = mapping.customer_accounts(raw[0])
    assert rows(accounts, "bank_id", "account_number", "entity_id") == [
        ("1", "A1", "E1"), ("2", "B1", "E2"), ("X9", "X1", "E3")]


def test_enrichment_keeps_unmatched_transactions(enriched, rows):
    assert rows(enriched, "from_account", "sender_entity_id", "receiver_entity_id") == [
        ("A1", "E1", "E2"), ("A1", None, "E1"), ("B1", "E2", "E3"), ("ZZ", None, "E1")]
    bad_time = enriched.filter("from_account = 'ZZ'").first()
    assert bad_time.transaction_timestamp is None and bad_time.transaction_date is None


def test_mapping_summary(enriched):
    row = mapping.mapping_summary(enriched).first()
    assert (row.transactions, row.unmatched_senders, row.unmatched_receivers) == (4, 2, 0)
    assert (row.distinct_sender_entities, row.distinct_receiver_entities) == (2, 3)
    assert (row.sender_match_percentage, row.receiver_match_percentage) == (50.0, 100.0)


def test_mapping_summary_of_nothing(enriched):
    row = mapping.mapping_summary(enriched.limit(0)).first()
    assert (row.transactions, row.unmatched_senders, row.sender_match_percentage) == (0, 0, None)


def test_target_uses_both_sides_and_only_the_population(enriched, rows):
    observation = temporal.within_dates(enriched, "2022-09-01", "2022-09-02")
    outcome = temporal.within_dates(enriched, "2022-09-08", "2022-09-10")
    target = temporal.customer_target(observation, outcome)
    assert rows(target, "entity_id", "future_aml_event") == [("E1", 1), ("E2", 0), ("E3", 0)]
    assert rows(temporal.target_summary(target)) == [(0, 2, 66.6667), (1, 1, 33.3333)]
    only_outcome = temporal.customer_target(outcome.limit(0), outcome)
    assert only_outcome.count() == 0


def test_entity_name_is_the_smallest(spark, rows):
    pairs = spark.createDataFrame([("E1", "b"), ("E1", "a"), ("E2", None)], "entity_id string, entity_name string")
    assert rows(mapping.entity_names(pairs)) == [("E1", "a"), ("E2", None)]


def test_accounts_per_entity_breaks_ties_by_id(spark):
    accounts = spark.createDataFrame(
        [("E2", "n", "1"), ("E1", "n", "1"), ("E3", "n", "1"), ("E3", "n", "2")],
        "entity_id string, entity_name string, bank_id string")
    assert [tuple(r) for r in mapping.accounts_per_entity(accounts, top=2).collect()] == [
        ("E3", "n", 2, 2), ("E1", "n", 1, 1)]


def test_distinct_counts_keep_keys_without_values(spark, rows):
    frame = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "k int, x string, y string")
    got = counting.distinct_counts(frame, "k", {"xs": F.col("x"), "ys": F.col("y")})
    assert rows(got) == [(1, 2, 0), (2, 0, 0)]


def test_daily_profile_counts_unmatched_rows(enriched, rows):
    daily = rows(audit.daily_profile(enriched), "transaction_date", "transactions",
                 "laundering_transactions", "sender_entities", "receiver_entities")
    assert [r[1:] for r in daily] == [(1, 0, 1, 1), (1, 1, 1, 1), (1, 1, 0, 1), (1, 0, 0, 1)]


def test_names_are_reduced_by_hash_before_any_sort(spark):
    pairs = spark.range(50).selectExpr("'E' || (id % 7) entity_id", "'n' || id entity_name")
    plan = mapping.entity_names(pairs)._jdf.queryExecution().executedPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest
