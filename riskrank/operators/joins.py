"""Joins that hold when one key owns a third of the rows, and size-checked broadcasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.session import materialise

HOT_SHARE = 4000  # no more than HOT_SHARE keys can each hold over 1/HOT_SHARE of the rows
SKETCH_ITEMS = 20_000
SKETCH_GROUPS = 512  # partial sketches merge in this many tasks before the last one

HotKeys = dict[int, int]  # key hash -> number of lanes


def hot_digests(df: DataFrame, keys: dict[str, list[str]]) -> dict[str, HotKeys]:
    """Hashes of keys too large for one shuffle partition, with the lanes each one needs.

    A key is hot when it holds more rows than an average shuffle partition (but
    not less than ``1/HOT_SHARE`` of all rows); it gets about two lanes per
    average partition it would fill. One column-pruned pass with mergeable
    frequent-items sketches, merged in two levels; at most ``HOT_SHARE``
    numbers per key reach the driver. The answer only decides where rows are
    processed: a key missed or listed wrongly changes speed, not results.
    """
    present = df.select(
        (F.spark_partition_id() % SKETCH_GROUPS).alias("_part"),
        *[F.when(_all_present(cols), F.xxhash64(*cols)).alias(name)
          for name, cols in keys.items()],
    )
    sketches = present.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.expr(f"approx_top_k_accumulate({name}, {SKETCH_ITEMS})").alias(name) for name in keys],
    )
    # Combining sketches of an empty input fails without a grouping key, hence the constant one.
    merged = sketches.groupBy((F.col("_part") * 0).alias("_all")).agg(
        F.sum("_rows").alias("_rows"),
        *[F.expr(f"approx_top_k_combine({name}, {SKETCH_ITEMS})").alias(name) for name in keys],
    ).select("_rows", *[
        F.expr(f"approx_top_k_estimate({name}, {HOT_SHARE})").alias(name) for name in keys])
    row = merged.first()
    if row is None:
        return {name: {} for name in keys}
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = max(1.0 / HOT_SHARE, 1.0 / partitions)
    found: dict[str, HotKeys] = {}
    for name in keys:
        shares = {top["item"]: top["count"] / row["_rows"] for top in row[name] or []
                  if top["item"] is not None}
        # Powers of two keep the number of different lane counts small.
        found[name] = {digest: 1 << math.ceil(math.log2(max(2.0, 2.0 * part * partitions)))
                       for digest, part in shares.items() if part > floor}
    return found


def _all_present(cols: list[str]) -> Column:
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    return present


def lane_count(cols: list[str], hot: HotKeys) -> Column:
    """Number of lanes of a row's key; 1 for a key that is not hot."""
    digest, count = F.xxhash64(*cols), F.lit(1)
    for lanes in sorted(set(hot.values())):
        members = [d for d, n in hot.items() if n == lanes]
        count = F.when(digest.isin(members), lanes).otherwise(count)
    return count


def lane_of(content: list[str], lanes: Column | int) -> Column:
    """A lane in ``[0, lanes)`` by content: a re-run task sends a row to the same place.

    The content is only hashed where there is more than one lane.
    """
    count = F.lit(lanes) if isinstance(lanes, int) else lanes
    return F.when(count > 1, F.pmod(F.xxhash64(*content), count).cast("int")).otherwise(F.lit(0))


def spread_left_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]],
                     hot: HotKeys | None = None, hashed: bool = False) -> DataFrame:
    """Left equi-join with the hot keys of the left side split over lanes.

    ``on`` pairs left and right columns; the right key columns are dropped from
    the result. Keys of unequal types are compared and dealt as their common
    type. The right rows of a hot key are repeated once per lane; all
    other keys stay in lane 0 and are shuffled as they are. Rows with a NULL
    key cannot match, so they are spread over as many lanes as there are
    partitions. ``hot`` may be passed when a cheaper frame has the same keys.
    ``hashed`` asks for a hash table of the right rows of each partition, which
    must fit a task, instead of sorting both sides: wide left rows are not held.
    """
    left_keys = [l for l, _ in on]
    right_keys = [r for _, r in on]
    if hot is None:
        hot = hot_digests(left, {"joined": left_keys})["joined"]
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = [_common_type(left, l, right, r) for l, r in on]
    # A key of the common type joins as it is: a copy of it would cross the network with every row.
    own = [l if left.schema[l].dataType == kind else f"_own_{i}"
           for i, (l, kind) in enumerate(zip(left_keys, common))]
    cast_keys = {o: F.col(l).cast(kind) for o, l, kind in zip(own, left_keys, common) if o != l}
    keyed = left.withColumns(cast_keys) if cast_keys else left
    lanes = F.when(_all_present(own), lane_count(own, hot)).otherwise(F.lit(partitions))
    spread = keyed.withColumn("_lane", lane_of(left.columns, lanes))
    # Generated rather than a plain 0 where nothing is hot: a constant would be
    # folded out of the join key, and NULL keys would meet in one partition again.
    theirs = [f"_key_{i}" for i in range(len(on))]
    cast = right.withColumns({t: F.col(r).cast(kind) for t, r, kind in zip(theirs, right_keys, common)})
    copies = cast.drop(*right_keys).withColumn(
        "_right_lane", F.explode(F.sequence(F.lit(0), lane_count(theirs, hot) - 1)))
    if hashed:
        copies = copies.hint("shuffle_hash")
    matches = F.col("_lane") == F.col("_right_lane")
    for o, t in zip(own, theirs):
        matches = matches & (F.col(o) == F.col(t))
    return spread.join(copies, matches, "left").drop("_lane", "_right_lane", *cast_keys, *theirs)


def _common_type(left: DataFrame, left_key: str, right: DataFrame, right_key: str):
    """The type in which Spark would compare the two columns."""
    kinds = [left.schema[left_key].dataType, right.schema[right_key].dataType]
    if kinds[0] == kinds[1]:
        return kinds[0]
    nulls = [F.lit(None).cast(kind) for kind in kinds]
    return left.sparkSession.range(0).select(F.coalesce(*nulls).alias("key")).schema["key"].dataType


def attach_dimension(left: DataFrame, dimension: DataFrame, on: str,
                     max_rows: int = 10_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Left join of a small per-key table (one row per ``on`` value).

    The dimension is evaluated once and stored. Up to ``max_rows`` rows and
    ``max_bytes`` it is broadcast, which leaves ``left`` where it is; a larger
    one goes through the spread join, so its size is never assumed. Columns come
    as those of ``left``, then those of the dimension, on either way.
    """
    stored = materialise(dimension, "dimension")
    columns = [*left.columns, *[c for c in dimension.columns if c != on]]
    head = stored.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= max_bytes:
        small = left.sparkSession.createDataFrame(head, dimension.schema)
        return left.join(F.broadcast(small), on, "left").select(*columns)
    return spread_left_join(left, stored.withColumnRenamed(on, "_dimension_key"),
                            [(on, "_dimension_key")]).select(*columns)
