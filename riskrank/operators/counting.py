"""Shares of a total and several distinct counts in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.maths import percent


def share_of_total(counts: DataFrame, digits: int, count: str = "count") -> DataFrame:
    """Add each row's percentage of the grand total of a grouped frame.

    The total is a scalar subquery over the same grouped rows, whose exchange
    Spark reuses: no window squeezes the groups into one partition.
    """
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("percentage", percent(F.col(count), total, digits))


def distribution(df: DataFrame, key: str, digits: int) -> DataFrame:
    return share_of_total(df.groupBy(key).count(), digits)


def distinct_counts(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """One row per key with the number of distinct non-NULL values of each expression.

    Every row turns into one (key, position, value) row per expression;
    duplicates vanish map-side and again on their own hash partition, so a hot
    key is spread over its values. Only the per-value rows are then counted.
    """
    names = list(values)
    pairs = F.array(*[
        F.struct(F.lit(i).alias("slot"), expr.cast("string").alias("value"))
        for i, expr in enumerate(values.values())
    ])
    distinct = (
        df.select(F.col(key), F.inline(pairs))
        .filter(F.col("value").isNotNull() | (F.col("slot") == 0))
        .distinct()
    )
    return distinct.groupBy(key).agg(*[
        F.count_if((F.col("slot") == i) & F.col("value").isNotNull()).alias(name)
        for i, name in enumerate(names)
    ])
