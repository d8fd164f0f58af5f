import math

import pytest
from pyspark.sql import functions as F

from riskrank.functions import keys, maths


def values(spark, kind, items, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expr).collect()]


def test_canonical_bank(spark):
    given = ["021174", "21174", " 77", "AB12 ", None, "99999999999999999999"]
    assert values(spark, "string", given, keys.canonical_bank("x")) == [
        "21174", "21174", "77", "AB12", None, "99999999999999999999"]


def test_canonical_account(spark):
    assert values(spark, "string", [" c17 ", None], keys.canonical_account("x")) == ["C17", None]


def test_hash_numbers(spark):
    assert values(spark, "string", ["17"], keys.hash_number("x", 101)) == [-949408272632522661]
    assert values(spark, "string", ["E1"], keys.hash_bucket("x", 101)) == [14]
    assert values(spark, "string", ["17"], keys.hash_bucket("x", 101, algo="md5")) == [51]
    with pytest.raises(ValueError):
        keys.hash_number("x", 1, "sha1")


def test_weighted_label_follows_cumulative_shares(spark):
    label = keys.weighted_label(F.col("x"), [("a", 75), ("b", 20), ("c", 5)])
    assert values(spark, "int", [0, 74, 75, 94, 95, 99], label) == list("aabbcc")


def test_share_and_percent(spark):
    assert values(spark, "int", [0, 4], maths.share(F.lit(1), F.col("x"))) == [0.0, 0.25]
    assert values(spark, "int", [0, 3], maths.percent(F.lit(1), F.col("x"), 4)) == [None, 33.3333]


def test_clip_and_finite(spark):
    given = [-9.0, 3.0, 20.0, None]
    assert values(spark, "double", given, maths.clip(F.col("x"), -5.0, 10.0)) == [-5, 3, 10, None]
    odd = [float("inf"), float("-inf"), float("nan"), None, 2.5]
    assert values(spark, "double", odd, maths.finite_or(F.col("x"), 0.0)) == [0, 0, 0, 0, 2.5]


def test_erfc_is_accurate(spark):
    points = [0.0, 0.1, 0.5, 1.0, 2.0, 4.0]
    for x, got in zip(points, values(spark, "double", points, maths.erfc(F.col("x")))):
        assert got == pytest.approx(math.erfc(x), rel=2e-7)


@pytest.mark.parametrize("dof,statistic", [(1, 3.8415), (2, 5.9915), (3, 7.8147), (4, 9.4877),
                                           (5, 11.0705), (9, 16.919)])
def test_chi_square_tail_at_published_five_percent_points(spark, dof, statistic):
    tail = maths.chi_square_tail(F.lit(statistic), F.lit(dof))
    assert values(spark, "int", [0], tail)[0] == pytest.approx(0.05, abs=2e-6)


def test_chi_square_tail_without_freedom(spark):
    assert values(spark, "int", [0], maths.chi_square_tail(F.lit(0.0), F.lit(0))) == [1.0]
