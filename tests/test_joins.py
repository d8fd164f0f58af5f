"""Skew-safe joins: same rows as a plain join, hot keys split, NULL keys spread."""

import pytest
from pyspark.sql import functions as F

from riskrank.operators import joins


@pytest.fixture(scope="module")
def skewed(spark):
    # Key 7 holds half of the rows, a quarter has no key, the rest is spread out.
    return spark.range(4000).select(
        "id",
        F.when(F.col("id") % 4 < 2, 7).when(F.col("id") % 4 == 2, F.lit(None))
        .otherwise(F.col("id") % 500 + 10).alias("k"),
        (F.col("id") % 3).alias("k2"),
    )


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.range(480 * 3).select(
        F.floor(F.col("id") / 3).alias("d"), (F.col("id") % 3).alias("d2"),
        F.concat(F.lit("v"), "id").alias("v"))


def test_hot_digests_finds_the_large_key_and_scales_its_lanes(spark, skewed):
    hot = joins.hot_digests(skewed, {"one": ["k"], "two": ["k", "k2"]})
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    assert hot["one"] == {seven: 8}  # half of 8 partitions, two lanes each
    assert len(hot["two"]) == 3


def test_hot_digests_of_an_empty_frame(skewed):
    assert joins.hot_digests(skewed.limit(0), {"one": ["k"]}) == {"one": {}}


@pytest.mark.parametrize("given", [None, {}])
def test_spread_left_join_equals_plain_join(skewed, dimension, rows, given):
    plain = skewed.join(
        dimension, (skewed.k == dimension.d) & (skewed.k2 == dimension.d2), "left"
    ).select("id", "k", "k2", "v")
    spread = joins.spread_left_join(skewed, dimension, [("k", "d"), ("k2", "d2")], hot=given)
    assert spread.columns == ["id", "k", "k2", "v"]
    assert rows(spread) == rows(plain)


def test_wrong_hot_list_does_not_change_results(spark, skewed, dimension, rows):
    keys = [("k", "d"), ("k2", "d2")]
    cold = spark.range(1).select(F.xxhash64(F.lit(13).cast("bigint"), F.lit(0).cast("bigint")))
    listed = joins.spread_left_join(skewed, dimension, keys, hot={cold.first()[0]: 16})
    assert rows(listed) == rows(joins.spread_left_join(skewed, dimension, keys))


def test_lanes_split_hot_and_null_keys(skewed):
    hot = joins.hot_digests(skewed, {"one": ["k"]})["one"]
    lanes = skewed.select("k", joins.lane_of(["id", "k", "k2"], joins.lane_count(["k"], hot))
                          .alias("lane")).distinct().groupBy("k").count().collect()
    by_key = {r["k"]: r["count"] for r in lanes}
    assert by_key[7] == 8
    assert by_key[13] == 1


def test_attach_dimension_broadcasts_small_and_survives_large(skewed, dimension, rows):
    small = dimension.filter("d2 = 0").select(F.col("d").alias("k"), "v")
    broadcast = joins.attach_dimension(skewed, small, "k")
    spread = joins.attach_dimension(skewed, small, "k", max_rows=10)
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    columns = ["id", "k", "k2", "v"]
    assert rows(broadcast, *columns) == rows(spread, *columns)


def test_null_keys_spread_even_without_hot_keys(skewed, dimension):
    plan = joins.spread_left_join(
        skewed, dimension, [("k", "d"), ("k2", "d2")], hot={})._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    join = next(line for line in text.splitlines() if "Join LeftOuter" in line)
    assert "_lane" in join and "_right_lane" in join


def test_attach_an_empty_dimension(skewed, dimension):
    got = joins.attach_dimension(skewed, dimension.limit(0).withColumnRenamed("d", "k"), "k")
    assert got.count() == 4000 and got.filter("v is not null").count() == 0
