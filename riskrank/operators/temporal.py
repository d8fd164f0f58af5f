"""Observation population and outcome label, kept apart in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.operators.counting import distribution
from riskrank.operators.mapping import entity_names


def within_dates(transactions: DataFrame, start: str, end: str,
                 column: str = "transaction_date") -> DataFrame:
    """Rows of an inclusive calendar window; the predicate reaches the parquet scan."""
    return transactions.filter(
        F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def participants(transactions: DataFrame) -> DataFrame:
    """Both sides of every transaction, unmatched sides left out, in one scan."""
    sides = F.array(*[
        F.struct(F.col(f"{role}_entity_id").alias("entity_id"),
                 F.col(f"{role}_entity_name").alias("entity_name"))
        for role in ("sender", "receiver")
    ])
    return transactions.select(F.inline(sides)).dropna(subset=["entity_id"])


def population(observation: DataFrame) -> DataFrame:
    """Every entity that took part in the observation window, once."""
    return entity_names(participants(observation))


def future_positives(outcome: DataFrame) -> DataFrame:
    """Entities on either side of a labelled transaction of the outcome window."""
    labelled = outcome.filter(F.col("is_laundering") == 1)
    return participants(labelled).select("entity_id").distinct().withColumn(
        "future_aml_event", F.lit(1))


def customer_target(observation: DataFrame, outcome: DataFrame) -> DataFrame:
    """The population with a 0/1 outcome."""
    return population(observation).join(future_positives(outcome), "entity_id", "left").na.fill(
        0, ["future_aml_event"])


def target_summary(target: DataFrame) -> DataFrame:
    return distribution(target, "future_aml_event", digits=4).orderBy("future_aml_event")
