"""Ordered running totals and exact quantiles without a single sorted partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskrank.operators.joins import attach_dimension
from riskrank.operators.selection import cuts_below
from riskrank.session import materialise

ROWS_PER_BUCKET = 500_000  # distinct values that one task may order
FAN_OUT = 1024  # ranges that a group is cut into at once; ranges still too large are cut again


def value_counts(df: DataFrame, group: str, value: str, weights: dict[str, Column]) -> DataFrame:
    """Collapse to one row per (group, value) with summed weights, stored once.

    Ties, however many rows they hold, become a single row before any ordering.
    """
    grouped = df.groupBy(group, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    return materialise(grouped, "value-counts")


def running_totals(counts: DataFrame, group: str, value: str, weights: list[str],
                   buckets: int | None = None, most_buckets: int = FAN_OUT, depth: int = 0) -> DataFrame:
    """Add ``<w>_before`` (sum over smaller values) and ``<w>_total`` per group.

    ``counts`` holds one row per (group, value) and is read several times, so
    it should be a stored table. Groups of up to ``ROWS_PER_BUCKET`` distinct
    values are ordered directly. Larger ones are cut into ranges of about
    equally many distinct values: sums of whole ranges give the offsets, and
    only rows of one range are ever ordered together. Ranges of groups too large
    for one cut are cut again, as groups of their own.
    """
    again = False
    if buckets is None:
        largest = counts.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        buckets = math.ceil(largest / ROWS_PER_BUCKET)
        again = buckets > most_buckets
        buckets = min(most_buckets, buckets)
    if buckets <= 1:
        return _window_totals(counts, [group], value, weights).withColumns({
            f"{w}_total": F.sum(w).over(Window.partitionBy(group)) for w in weights})

    fractions = [i / buckets for i in range(1, buckets)]
    # Cuts need not be exact: a coarse sketch keeps what is merged small.
    cuts = counts.groupBy(group).agg(F.percentile_approx(
        F.col(value).cast("double"), fractions, 4 * buckets).alias("_cuts"))
    placed = attach_dimension(counts, cuts, group).withColumn(
        "_bucket", cuts_below("_cuts", value, buckets)).drop("_cuts")

    per_bucket = placed.groupBy(group, "_bucket").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = _window_totals(per_bucket, [group], "_bucket", weights).select(
        group, "_bucket",
        *[F.col(f"{w}_before").alias(f"_{w}_offset") for w in weights],
        *[F.sum(w).over(Window.partitionBy(group)).alias(f"{w}_total") for w in weights],
    )
    # A NULL group is a group like any other, so the join treats NULLs as equal.
    offsets = offsets.withColumnsRenamed({group: "_offset_group", "_bucket": "_offset_bucket"})
    joined = placed.join(
        offsets, F.col(group).eqNullSafe(F.col("_offset_group"))
        & (F.col("_bucket") == F.col("_offset_bucket"))).drop("_offset_group", "_offset_bucket")
    if again:
        held = {f"_{w}_offset": f"_{w}_offset_{depth}" for w in weights} | {
            f"{w}_total": f"_{w}_total_{depth}" for w in weights}
        ranges = materialise(joined.withColumn("_range", F.struct(group, "_bucket")).drop("_bucket")
                             .withColumnRenamed("_range", f"_range_{depth}").withColumnsRenamed(held), "value-ranges")
        inside = running_totals(ranges, f"_range_{depth}", value, weights, None, most_buckets, depth + 1).drop(
            f"_range_{depth}", *[f"{w}_total" for w in weights]).withColumnsRenamed({v: k for k, v in held.items()})
    else:
        inside = _window_totals(joined, [group, "_bucket"], value, weights).drop("_bucket")
    return inside.withColumns({
        f"{w}_before": F.col(f"{w}_before") + F.col(f"_{w}_offset") for w in weights
    }).drop(*[f"_{w}_offset" for w in weights])


def _window_totals(df: DataFrame, keys: list[str], order: str, weights: list[str]) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        f"{w}_before": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in weights})


def quantile_columns(value: str, weight: str, probabilities: dict[str, float]) -> list[Column]:
    """Aggregates over ranked rows that give exact, linearly interpolated quantiles.

    Each quantile sits at position q * (n - 1) of the sorted sample; the rows
    covering its floor and ceiling are picked by their running counts.
    """
    before, total = F.col(f"{weight}_before"), F.col(f"{weight}_total")
    upto = before + F.col(weight)
    result = []
    for name, q in probabilities.items():
        # Rounding absorbs the binary error of products such as 0.9 * 10.
        position = F.round(F.lit(q) * (total - 1), 9)

        def at(index: Column) -> Column:
            covers = (before <= index) & (index < upto)
            return F.max(F.when(covers, F.col(value).cast("double")))

        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        result.append((low + (high - low) * fraction).alias(name))
    return result


def quantiles(ranked: DataFrame, group: str, value: str, weight: str,
              probabilities: dict[str, float]) -> DataFrame:
    """One row per group with a column per requested quantile."""
    return ranked.groupBy(group).agg(*quantile_columns(value, weight, probabilities))
