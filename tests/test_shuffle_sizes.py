"""What crosses the network, is sorted or is held: joins of accounts, activity, boosting sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.models import additive
from riskrank.operators import behaviour, mapping
from riskrank.plans import review
from riskrank.schemas import ACC_RAW, TX_RAW

ENDS = "from_bank_id string, from_account string, to_bank_id string, to_account string, n int"


@pytest.fixture(scope="module")
def accounts(spark):
    # C1 has two owners; two accounts have no number.
    rows = [("1", f"C{i % 40 + 1}", f"E{i}", f"Name {i}") for i in range(41)]
    rows += [("2", "S1", "E90", None), ("2", "S2", None, "Nobody"), ("2", None, "E91", "x"), (None, None, "E92", "y")]
    return spark.createDataFrame(
        rows, "bank_id string, account_number string, entity_id string, entity_name string")


@pytest.fixture(scope="module")
def transactions(spark):
    rows = [("1", f"C{i % 50 + 1}", "2", f"S{i % 3 + 1}", i) for i in range(300)]
    rows += [(None, "C1", "2", None, 300), ("1", None, None, None, 301), ("1", "C2", "2", "S1", 2)]
    return spark.createDataFrame(rows, ENDS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_accounts_are_sent_to_the_transactions_which_stay(spark, transactions, accounts):
    set_before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(mapping.enrich_transactions(transactions, accounts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", set_before)
    assert "hashpartitioning" not in plan and "Sort" not in plan


@pytest.mark.parametrize("most, shuffled", [(1_000_000, 0), (10, 1), (1, 2)])
def test_accounts_join_alike_by_broadcast_and_by_shuffle(monkeypatch, transactions, accounts, rows, most, shuffled):
    want = transactions
    for role, side in (("sender", "from"), ("receiver", "to")):
        owners = accounts.select(F.col("bank_id").alias("b"), F.col("account_number").alias("a"),
                                 F.col("entity_id").alias(f"{role}_entity_id"),
                                 F.col("entity_name").alias(f"{role}_entity_name"))
        want = want.join(owners, (F.col(f"{side}_bank_id") == F.col("b")) & (F.col(f"{side}_account") == F.col("a")),
                         "left").drop("a", "b")
    monkeypatch.setattr(mapping, "LOOKUP_ROWS", most)
    got = mapping.enrich_transactions(transactions, accounts)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftOuter" in line]
    assert sum("_lane" in line for line in joins) == shuffled and len(joins) == 2


def test_enriched_rows_are_written_without_an_order(spark):
    kept = {}

    class Seen(Exception):
        pass

    def keep(name, df):
        kept[name] = df
        if name == "enriched_transactions":
            raise Seen
        return df

    raw = spark.createDataFrame(
        [("2022/09/01 10:00", "1", "A1", "2", "A2", 1.0, "EUR", 2.0, "USD", "Wire", 0)], TX_RAW)
    owners = spark.createDataFrame([("Bank", "1", "A1", "E1", "One"), ("Bank", "2", "A2", "E2", "Two")], ACC_RAW)
    with pytest.raises(Seen):
        review.build_features(owners, raw, review.PUBLISHED_WINDOWS, keep=keep)
    assert "transaction_date" in kept["enriched_transactions"].columns
    assert "Sort [transaction_date" not in plan_of(kept["enriched_transactions"])


def test_activity_partitions_follow_the_number_of_events(spark, monkeypatch, rows):
    events = spark.range(1200).select(
        F.sha2((F.col("id") % 1100).cast("string"), 256).alias("transaction_id"),
        F.lit("2022-09-01").cast("date").alias("transaction_date"), F.lit("Wire").alias("payment_format"),
        F.concat(F.lit("E"), F.col("id") % 70).alias("entity_id"), F.lit("E1").alias("counterparty_entity_id"),
        F.lit("7").alias("counterparty_bank_id"), F.lit("OUT").alias("direction"), F.lit("EUR").alias("currency"),
        F.lit(1).alias("is_cross_bank"), F.lit(0).alias("is_self_transfer"), F.lit(0.5).alias("amount_zscore"))
    whole = rows(behaviour.customer_activity(events, {}))
    monkeypatch.setattr(behaviour, "EVENTS_PER_TASK", 100)
    many = behaviour.customer_activity(events, {})
    assert "hashpartitioning(entity_id" in plan_of(many) and ", 12), REPARTITION_BY_NUM" in plan_of(many)
    assert rows(many) == whole
    assert sum(r["transaction_count"] for r in many.collect()) == 1200 - sum(
        1 for i in range(100) if i % 70 == (i + 1100) % 70)


def test_later_rounds_bring_back_sums_of_active_bags_without_counts(spark):
    rng = np.random.default_rng(3)
    blocks = [(rng.integers(0, 4, (2, 50)), rng.integers(0, 2, 50).astype(np.uint8),
               rng.integers(0, 8, 50).astype(np.uint32)) for _ in range(3)]
    offsets, tables, intercepts = np.array([0, 5, 10]), rng.normal(size=(3, 10)), rng.normal(size=3)
    rdd = spark.sparkContext.parallelize(blocks, 3)
    first = additive._round_sums(rdd, tables, intercepts, offsets, [0, 1, 2])
    later = additive._round_sums(rdd, tables, intercepts, offsets, [0, 2], first["n"])
    assert additive._block_sums(blocks[0], offsets[:-1], tables, intercepts, [2], False).shape == (2, 1, 11)
    for name in ("gradient", "curvature"):
        assert (later[name][[0, 2]] == first[name][[0, 2]]).all() and not later[name][1].any()
    assert (later["n"] == first["n"]).all() and first["n"][:, :5].sum() + first["n"][:, 10].sum() == 450
