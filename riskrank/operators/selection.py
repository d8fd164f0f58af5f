"""Exact ranks by selection: a few counting passes, no ordering and no store of distinct values.

Each wanted rank has an open interval of values it lies in, at first all of them. A
pass cuts every interval at about a thousand values, which a mergeable sketch
proposes, counts the rows between and at the cuts exactly, and goes on with the one
stretch that holds the rank. The sketch decides how fast intervals shrink (some
hundredfold a pass), the counts alone decide the answer. What a pass brings back is a fixed number of
counts per group and rank. Once an interval holds few rows, its values are ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskrank.operators.joins import attach_dimension
from riskrank.session import materialise

CUTS = 1000  # per interval and pass
ORDERED_ROWS = 500_000  # an interval of so many rows is ordered
KEYS = ["_group", "_name"]


def select_ranks(df: DataFrame, group: str, value: str, positions: dict[str, Callable[[Column], Column]],
                 weight: str | None = None, ordered_rows: int = ORDERED_ROWS, cuts: int = CUTS) -> DataFrame:
    """(group, name, name, ...): the values at the given positions of each group's ascending rows.

    ``positions`` gives the place, from 0, as a function of the number of rows (or of the
    sum of ``weight``, a column of whole numbers that says how often a row counts). A
    position outside the group gives NULL. Rows with a NULL value do not count; a NULL
    group is a group. ``df`` is read once per pass, so it should be a stored table.
    """
    kind = df.schema[value].dataType.simpleString()
    rows = df.select(F.struct(F.col(group).alias("key")).alias("_group"), F.col(value).alias("_value"),
                     (F.col(weight) if weight else F.lit(1)).cast("long").alias("_weight")).where(
        F.col("_value").isNotNull() & (F.col("_weight") > 0))
    sizes = materialise(rows.groupBy("_group").agg(
        F.sum("_weight").alias("_total"), F.count(F.lit(1)).alias("_rows")), "rank-sizes")
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), place(F.col("_total")).cast("long").alias("_rank"))
                      for name, place in positions.items()])
    none = F.lit(None).cast(kind)
    open_ = materialise(sizes.select("_group", "_total", "_rows", F.inline(asked)).where(
        (F.col("_rank") >= 0) & (F.col("_rank") < F.col("_total"))).select(
        *KEYS, "_rank", "_rows", none.alias("_low"), none.alias("_high")), "rank-intervals")
    found = []
    while True:
        small = open_.where(F.col("_rows") <= ordered_rows)
        found.append(materialise(_ordered(rows, small), "ranks"))
        open_ = open_.where(F.col("_rows") > ordered_rows)
        if open_.isEmpty():
            break
        narrowed = materialise(_narrowed(rows, open_, cuts), "rank-intervals")
        found.append(narrowed.where(F.col("_hit").isNotNull()).select(*KEYS, F.col("_hit").alias("_value")))
        open_ = narrowed.where(F.col("_hit").isNull()).drop("_hit")
    settled = found[0]
    for part in found[1:]:
        settled = settled.union(part)
    wide = settled.groupBy("_group").agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in positions])
    return sizes.select("_group").join(wide, "_group", "left").select(
        F.col("_group.key").alias(group), *positions)


def _inside(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of each interval, once per interval they lie in, with what is known of it."""
    known = [c for c in intervals.columns if c != "_group"]
    per_group = intervals.groupBy("_group").agg(F.collect_list(F.struct(*known)).alias("_asked"))
    holds = lambda i: ((i["_low"].isNull() | (F.col("_value") > i["_low"]))
                       & (i["_high"].isNull() | (F.col("_value") < i["_high"])))
    matched = attach_dimension(rows, per_group, "_group").withColumn("_asked", F.filter("_asked", holds))
    return matched.select("_group", "_value", "_weight", F.inline("_asked"))


def _picked(counted: DataFrame, order: str) -> DataFrame:
    """The row of each interval that covers the rank, with the weight before it."""
    earlier = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    return counted.withColumn("_before", before).where(
        (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_weight")))


def _ordered(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """(group, name, value) of intervals with few rows."""
    counted = _inside(rows, intervals).groupBy(*KEYS, "_rank", "_value").agg(F.sum("_weight").alias("_weight"))
    return _picked(counted, "_value").select(*KEYS, "_value")


def _narrowed(rows: DataFrame, intervals: DataFrame, cuts: int) -> DataFrame:
    """Intervals cut down to the stretch that holds their rank; ``_hit`` where the rank falls on a cut itself."""
    fractions = [i / cuts for i in range(cuts + 1)]
    proposed = materialise(_inside(rows, intervals).groupBy(*KEYS).agg(
        F.array_sort(F.array_distinct(F.percentile_approx("_value", fractions, 4 * cuts))).alias("_cuts")), "rank-cuts")
    placed = _inside(rows, intervals.join(proposed, KEYS)).withColumn("_below", cuts_below("_cuts", "_value", cuts + 1))
    # Stretches and cuts alternate: 2k is what lies below cut k, 2k + 1 the cut itself.
    stretch = 2 * F.col("_below") + F.when(F.get("_cuts", F.col("_below")) == F.col("_value"), 1).otherwise(0)
    counted = placed.withColumn("_stretch", stretch).groupBy(*KEYS, "_rank", "_low", "_high", "_stretch").agg(
        F.sum("_weight").alias("_weight"), F.count(F.lit(1)).alias("_rows"))
    picked = _picked(counted, "_stretch").join(proposed, KEYS)
    at = F.floor(F.col("_stretch") / 2).cast("int")
    return picked.select(
        *KEYS, (F.col("_rank") - F.col("_before")).alias("_rank"), "_rows",
        F.when(at > 0, F.get("_cuts", at - 1)).otherwise(F.col("_low")).alias("_low"),
        F.coalesce(F.get("_cuts", at), F.col("_high")).alias("_high"),
        F.when(F.col("_stretch") % 2 == 1, F.get("_cuts", at)).alias("_hit"))


def cuts_below(cuts: str, value: str, most: int) -> Column:
    """How many of a row's sorted ``cuts``, at most ``most``, lie below the value, by halving steps."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda found, step: found + F.when(F.get(cuts, found + step - 1) < F.col(value), step).otherwise(0))


def selected_quantiles(df: DataFrame, group: str, value: str, probabilities: dict[str, float],
                       weight: str | None = None, **how) -> DataFrame:
    """One row per group with a column per exact, linearly interpolated quantile.

    A quantile sits at position q * (n - 1) of the ascending rows, between the
    values at its floor and its ceiling.
    """
    # Rounding absorbs the binary error of products such as 0.9 * 10.
    place = lambda q, total: F.round(F.lit(q) * (total - 1), 9)
    positions: dict[str, Callable[[Column], Column]] = {"_n": lambda total: F.lit(0)}
    for name, q in probabilities.items():
        positions[f"_floor_{name}"] = lambda total, q=q: F.floor(place(q, total))
        positions[f"_ceil_{name}"] = lambda total, q=q: F.ceil(place(q, total))
    ends = select_ranks(df, group, value, positions, weight, **how)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_same")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_total"))
    joined = ends.join(counts, F.col(group).eqNullSafe(F.col("_same")))
    result = []
    for name, q in probabilities.items():
        low, high = (F.col(f"_{end}_{name}").cast("double") for end in ("floor", "ceil"))
        position = place(q, F.col("_total"))
        result.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return joined.select(group, *result)
