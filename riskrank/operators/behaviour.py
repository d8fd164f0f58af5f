"""Behavioural features: directional events, currency-aware amounts, activity, ratios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.functions.maths import share
from riskrank.operators.joins import (
    HotKeys, attach_dimension, hot_digests, lane_count, lane_of,
)

# Fixed value: fields whose texts, joined by "||", identify a transaction.
ID_FIELDS = [
    "transaction_timestamp", "from_bank_id", "from_account", "to_bank_id", "to_account",
    "amount_paid", "amount_received", "payment_currency", "receiving_currency", "payment_format",
]
LARGE_ZSCORE = 2.5
EVENTS_PER_TASK = 250_000  # an event takes up to six rows of the task's hash tables

# The number of distinct transactions of an entity that show each trait.
TRANSACTION_COUNTS = [
    "transaction_count", "outgoing_tx_count", "incoming_tx_count", "unusually_large_tx_count",
    "cross_bank_tx_count", "self_transfer_tx_count",
]
DISTINCT_COUNTS = {
    "active_days": "transaction_date",
    "counterparty_count": "other_party",
    "counterparty_bank_count": "counterparty_bank_id",
    "currency_count": "currency",
    "payment_format_count": "payment_format",
}
ZSCORES = ["average_amount_zscore", "maximum_amount_zscore"]
MEASURES = TRANSACTION_COUNTS + list(DISTINCT_COUNTS) + ZSCORES


def with_transaction_id(transactions: DataFrame) -> DataFrame:
    text = F.concat_ws("||", *[F.col(c).cast("string") for c in ID_FIELDS])
    return transactions.withColumn("transaction_id", F.sha2(text, 256))


def directional_events(transactions: DataFrame) -> DataFrame:
    """Each transaction seen from both ends, in one scan; ends without entity drop out."""
    ends = {"sender": ("from_bank_id", "OUT", "amount_paid", "payment_currency"),
            "receiver": ("to_bank_id", "IN", "amount_received", "receiving_currency")}

    def view(own: str, other: str):
        bank, direction, amount, currency = ends[own]
        return F.struct(
            F.col(f"{own}_entity_id").alias("entity_id"),
            F.col(f"{other}_entity_id").alias("counterparty_entity_id"),
            F.col(bank).alias("entity_bank_id"),
            F.col(ends[other][0]).alias("counterparty_bank_id"),
            F.lit(direction).alias("direction"),
            F.col(amount).alias("amount"),
            F.col(currency).alias("currency"),
        )

    both = F.array(view("sender", "receiver"), view("receiver", "sender"))
    return (
        with_transaction_id(transactions)
        .select("transaction_id", "transaction_date", "payment_format", F.inline(both))
        .dropna(subset=["entity_id"])
    )


def with_log_amount(events: DataFrame) -> DataFrame:
    """Natural log of the amount plus one; a missing amount counts as zero."""
    return events.withColumn("log_amount", F.log1p(F.coalesce("amount", F.lit(0.0))))


def currency_statistics(events: DataFrame) -> DataFrame:
    """Mean and sample deviation of the log amount per currency (partial aggregation only)."""
    return with_log_amount(events).groupBy("currency").agg(
        F.avg("log_amount").alias("currency_mean"),
        F.stddev_samp("log_amount").alias("currency_std"),
    )


def standardise_amounts(events: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Add the z-score of the log amount within its currency and the two link flags.

    The per-currency table is attached by a size-checked broadcast: a window
    over currency would pile all events onto a handful of partitions.
    """
    known = (currency_statistics(events) if statistics is None else statistics).dropna(
        subset=["currency"])
    spread = F.col("currency_std")
    zscore = F.when(spread > 0, (F.col("log_amount") - F.col("currency_mean")) / spread)
    return attach_dimension(with_log_amount(events), known, "currency").withColumns({
        # An undefined or zero deviation means the amount cannot stand out.
        "amount_zscore": F.when(spread.isNull() | (spread == 0), F.lit(0.0)).otherwise(zscore),
        "is_cross_bank": (F.col("entity_bank_id") != F.col("counterparty_bank_id")).cast("int"),
        "is_self_transfer": (F.col("entity_id") == F.col("counterparty_entity_id")).cast("int"),
    })


def customer_activity(events: DataFrame, hot: HotKeys | None = None,
                      hex_ids: bool = True) -> DataFrame:
    """The thirteen measures of every entity with at least one event.

    The events cross the network once, hashed by entity. On its partition every
    event becomes one row for its transaction and one per counted dimension, so
    all distinct counts are local groupings and end in one row per entity. The
    events are counted first, so that the number of partitions follows their
    number and not their bytes on the network, which these rows exceed many times.

    A hot entity is split over lanes by transaction. Each lane then sends a few
    subtotals and its distinct dimension values, which still have to be merged
    across lanes. ``hot`` takes the hot entities when a cheaper frame can
    supply them; ``hex_ids`` packs the hexadecimal digests of
    ``with_transaction_id`` to their first 16 bytes, on which no two of 10^10
    transactions agree but with probability 1.5e-19, and must be off for ids of
    any other form.
    """
    if hot is None:
        hot = hot_digests(events, {"entity": ["entity_id"]})["entity"]
    traits = {
        "outgoing_tx_count": F.col("direction") == "OUT",
        "incoming_tx_count": F.col("direction") == "IN",
        "unusually_large_tx_count": F.col("amount_zscore") >= LARGE_ZSCORE,
        "cross_bank_tx_count": F.col("is_cross_bank") == 1,
        "self_transfer_tx_count": F.col("is_self_transfer") == 1,
    }
    bits = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(traits.values())),
               F.lit(0))
    not_self = F.when(
        F.col("entity_id") != F.col("counterparty_entity_id"), F.col("counterparty_entity_id"))
    digest = F.col("transaction_id").cast("binary")
    if hex_ids:
        digest = F.unhex(F.substring("transaction_id", 1, 32))
    prepared = events.withColumns({"other_party": not_self, "bits": bits, "tx": digest})
    home = ["entity_id"]
    if hot:
        home = ["entity_id", "lane"]
        prepared = prepared.withColumn("lane", lane_of(["tx"], lane_count(["entity_id"], hot)))
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, math.ceil(events.count() / EVENTS_PER_TASK))
    placed = prepared.select(
        *home, "tx", "bits", "amount_zscore", *DISTINCT_COUNTS.values()).repartition(tasks, *home)

    cells = [F.struct(F.lit(0).alias("slot"), F.col("tx").alias("value"),
                      F.col("bits").alias("bits"), F.col("amount_zscore").alias("z"))]
    cells += [
        F.struct(F.lit(i).alias("slot"), F.col(c).cast("string").cast("binary").alias("value"),
                 F.lit(0).alias("bits"), F.lit(None).cast("double").alias("z"))
        for i, c in enumerate(DISTINCT_COUNTS.values(), start=1)
    ]
    distinct = (
        placed.select(*home, F.inline(F.array(*cells)))
        .filter((F.col("slot") == 0) | F.col("value").isNotNull())
        .groupBy(*home, "slot", "value")
        .agg(F.bit_or("bits").alias("bits"), F.sum("z").alias("z_sum"),
             F.count("z").alias("z_count"), F.max("z").alias("z_max"))
    )
    subtotals = distinct.withColumns({
        "n": F.lit(1),
        **{name: F.shiftright("bits", i).bitwiseAND(1) for i, name in enumerate(traits)},
    })
    summed = ["n", *traits, "z_sum", "z_count"]

    def fold(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in summed], F.max("z_max").alias("z_max"))

    if hot:
        # A transaction lies in one lane, so only dimension values can repeat across lanes.
        whole = F.when((lane_count(["entity_id"], hot) > 1) & (F.col("slot") > 0), F.col("value"))
        subtotals = fold(subtotals.withColumn("whole", whole), *home, "slot", "whole")
        subtotals = fold(subtotals, "entity_id", "slot", "whole").withColumn(
            "n", F.when(F.col("whole").isNull(), F.col("n")).otherwise(1))
    counted = {
        name: F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0))
        for i, name in enumerate(["transaction_count", *DISTINCT_COUNTS])
    }
    return subtotals.groupBy("entity_id").agg(
        *[e.alias(c) for c, e in counted.items()],
        *[F.sum(c).alias(c) for c in traits],
        F.try_divide(F.sum("z_sum"), F.sum("z_count")).alias("average_amount_zscore"),
        F.max("z_max").alias("maximum_amount_zscore"),
    ).select("entity_id", *MEASURES)


def with_ratios(df: DataFrame) -> DataFrame:
    """The five ratios; a customer without activity gets 0, or 1 for in/out."""
    total = F.col("transaction_count")
    incoming, outgoing = (F.col(f"{d}_tx_count") + F.lit(1.0) for d in ("incoming", "outgoing"))
    return df.withColumns({
        "transactions_per_active_day": share(total, F.col("active_days")),
        "incoming_outgoing_ratio": incoming / outgoing,
        "cross_bank_ratio": share(F.col("cross_bank_tx_count"), total),
        "self_transfer_ratio": share(F.col("self_transfer_tx_count"), total),
        "unusually_large_tx_ratio": share(F.col("unusually_large_tx_count"), total),
    })


def customer_features(scored: DataFrame, activity: DataFrame) -> DataFrame:
    """Scorecard and behaviour side by side; customers without events count as zero."""
    joined = scored.join(activity, "entity_id", "left")
    filled = joined.na.fill(0, TRANSACTION_COUNTS + list(DISTINCT_COUNTS)).na.fill(0.0, ZSCORES)
    return with_ratios(filled)


def feature_means(features: DataFrame) -> DataFrame:
    """Rounded means per outcome."""
    # Averaged feature, reported name, decimals.
    reported = [
        ("transaction_count", "avg_transaction_count", 2),
        ("counterparty_count", "avg_counterparty_count", 2),
        ("transactions_per_active_day", "avg_transactions_per_day", 2),
        ("maximum_amount_zscore", "avg_maximum_amount_zscore", 3),
        ("cross_bank_ratio", "avg_cross_bank_ratio", 4),
        ("self_transfer_ratio", "avg_self_transfer_ratio", 4),
        ("account_count", "avg_account_count", 2),
        ("bank_count", "avg_bank_count", 2),
    ]
    return (
        features.groupBy("future_aml_event")
        .agg(F.count(F.lit(1)).alias("customers"),
             *[F.round(F.avg(c), digits).alias(name) for c, name, digits in reported])
        .orderBy("future_aml_event")
    )
