"""Results do not depend on table size, key type, NULL groups or odd numbers."""

from pyspark.sql import functions as F

from riskrank.functions.maths import clip
from riskrank.operators import joins
from riskrank.operators.mapping import deduplicate
from riskrank.operators.prepare import stratified_split
from riskrank.operators.ranked import running_totals
from riskrank.sources import files


def test_hot_keys_of_unequal_types_keep_their_matches(spark):
    left = spark.range(2000).select(
        "id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"))
    right = spark.range(3000).select(F.col("id").alias("d"), (F.col("id") * 2).alias("v"))
    for hot in (None, {}):
        got = joins.spread_left_join(left, right, [("k", "d")], hot)
        assert got.count() == 2000 and got.where("v is null or v != 2 * k").count() == 0
    digest = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    forced = joins.spread_left_join(left, right, [("k", "d")], {digest: 16})
    assert forced.where("v is null").count() == 0 and forced.columns == ["id", "k", "v"]


def test_dimension_joins_return_one_column_order(spark, rows):
    left = spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("k"), F.lit("x").alias("w"))
    dimension = spark.range(9).select((F.col("id") * 3).alias("v"), F.col("id").alias("k"))
    small, large = (joins.attach_dimension(left, dimension, "k", n) for n in (100, 2))
    assert small.columns == large.columns == ["id", "k", "w", "v"]
    assert rows(small) == rows(large)
    by_bytes = joins.attach_dimension(left, dimension, "k", max_bytes=1)
    assert rows(by_bytes) == rows(small)


def test_a_null_group_is_ranked_however_many_buckets(spark, rows):
    counts = spark.range(400).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    one, four = (running_totals(counts, "g", "v", ["n"], b).select("g", "v", "n_before", "n_total")
                 for b in (1, 4))
    assert one.count() == 400 and rows(one) == rows(four)


def test_rows_without_a_label_are_set_apart(spark):
    frame = spark.range(300).select(
        F.col("id").cast("string").alias("entity_id"),
        F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("int")).alias("future_aml_event"))
    split = stratified_split(frame)
    assert split.where("future_aml_event is null").select("split").distinct().first()[0] == "unlabelled"
    assert split.where("future_aml_event is not null and split = 'unlabelled'").count() == 0


def test_clip_keeps_nan_and_bounds_infinities(spark):
    frame = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (3.0,), (None,)], "x double")
    got = [r.y for r in frame.select(clip(F.col("x"), -5.0, 10.0).alias("y")).collect()]
    assert got[0] != got[0] and got[1:] == [10.0, -5.0, 3.0, None]


def test_deduplicate_keeps_the_smallest_row(spark, rows):
    frame = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "x")],
                                  "k string, n int, t string")
    assert rows(deduplicate(frame, ["k"])) == [("a", 1, "y"), ("b", None, "x")]


def test_inventory_is_recursive_and_reports_are_bounded(spark, tmp_path):
    import pytest
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "sub" / "b.csv").write_text("yy")
    assert [r.file_name for r in files.file_inventory(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]
    with pytest.raises(ValueError, match="no report"):
        files.write_result_csv(spark.range(11), str(tmp_path / "out"), most_rows=10)
