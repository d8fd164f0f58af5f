import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskrank.operators import ranked, stats


@pytest.fixture(scope="module")
def heavy(spark):
    """Two groups; one value holds a third of the first group."""
    n = F.col("id")
    return spark.range(9000).select(
        F.when(n % 5 == 0, "b").otherwise("a").alias("g"),
        F.when(n % 3 == 0, 1.5).otherwise((n * 7919 % 3001) / 10.0).alias("v"))


def test_running_totals_equal_a_plain_window(heavy, rows):
    counts = ranked.value_counts(heavy, "g", "v", {"n": F.lit(1)})
    plain = counts.withColumns({
        "n_before": F.coalesce(F.sum("n").over(
            Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)),
        "n_total": F.sum("n").over(Window.partitionBy("g"))})
    for buckets in (None, 1, 2, 7, 256):
        got = ranked.running_totals(counts, "g", "v", ["n"], buckets)
        assert rows(got, "g", "v", "n", "n_before", "n_total") == rows(
            plain, "g", "v", "n", "n_before", "n_total")


def test_quantiles_match_numpy(heavy):
    counts = ranked.value_counts(heavy, "g", "v", {"n": F.lit(1)})
    totals = ranked.running_totals(counts, "g", "v", ["n"])
    wanted = {"low": 0.0, "q10": 0.1, "mid": 0.5, "q90": 0.9, "p99": 0.99, "high": 1.0}
    got = {r.g: r for r in ranked.quantiles(totals, "g", "v", "n", wanted).collect()}
    for g in "ab":
        sample = np.array([r.v for r in heavy.filter(F.col("g") == g).collect()])
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(sample, q), rel=1e-12)


def test_quantile_of_a_single_value(spark):
    counts = ranked.value_counts(spark.createDataFrame([("a", 4.0)], "g string, v double"),
                                 "g", "v", {"n": F.lit(1)})
    totals = ranked.running_totals(counts, "g", "v", ["n"])
    assert ranked.quantiles(totals, "g", "v", "n", {"q": 0.9}).first()["q"] == 4.0


def labelled(spark, pos, neg):
    return spark.createDataFrame(
        [(1, v) for v in pos] + [(0, v) for v in neg], "future_aml_event int, x double")


def test_rank_test_known_answer(spark):
    row = stats.numeric_tests(labelled(spark, [3.0, 4.0, 5.0], [1.0, 2.0, 3.0]), ["x"]).first()
    assert row.p_value == pytest.approx(0.121183, abs=1e-6)
    assert row.rank_biserial_effect == pytest.approx(0.888889, abs=1e-6)
    assert (row.positive_median, row.negative_median) == (4.0, 2.0)


def test_rank_test_drops_missing_values(spark):
    row = stats.numeric_tests(
        labelled(spark, [3.0, 4.0, 5.0, None, float("nan")], [1.0, 2.0, 3.0, None]), ["x"]).first()
    assert row.rank_biserial_effect == pytest.approx(0.888889, abs=1e-6)


def test_rank_test_without_evidence_and_without_a_class(spark):
    same = stats.numeric_tests(labelled(spark, [2.0, 2.0], [2.0, 2.0]), ["x"]).first()
    assert (same.p_value, same.rank_biserial_effect, same.adjusted_p_value) == (1.0, 0.0, 1.0)
    alone = stats.numeric_tests(labelled(spark, [2.0, 3.0], []), ["x"]).first()
    assert alone.p_value is None and alone.rank_biserial_effect is None


def test_adjustment_multiplies_by_the_number_of_features(spark):
    frame = labelled(spark, [3.0, 4.0, 5.0], [1.0, 2.0, 3.0]).withColumn("y", F.lit(0.0))
    rows = {r.feature: r for r in stats.numeric_tests(frame, ["x", "y"]).collect()}
    assert rows["x"].adjusted_p_value == pytest.approx(2 * rows["x"].p_value)
    assert rows["y"].adjusted_p_value == 1.0


@pytest.mark.parametrize("effect,label", [
    (0.0, "negligible"), (-0.0999, "negligible"), (0.10, "small"), (-0.29, "small"),
    (0.30, "moderate"), (-0.50, "moderate"), (0.51, "strong")])
def test_effect_labels(spark, effect, label):
    assert spark.range(1).select(stats.effect_label(F.lit(effect))).first()[0] == label


def table(spark, cells):
    return spark.createDataFrame(cells, "feature string, level string, negatives long, positives long")


def test_chi_square_two_by_two_is_corrected(spark):
    row = stats.chi_square_from_counts(table(spark, [("f", "a", 10, 20), ("f", "b", 30, 15)])).first()
    assert row.chi_square == pytest.approx(6.752232, abs=1e-6)
    assert row.p_value == pytest.approx(0.009363, abs=1e-6)
    assert row.cramers_v == pytest.approx(0.300050, abs=1e-6)


def test_chi_square_larger_table_is_not_corrected(spark):
    cells = [("f", "a", 10, 20), ("f", "b", 30, 15), ("f", "c", 20, 20)]
    observed = np.array([[10, 20], [30, 15], [20, 20]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    wanted = ((observed - expected) ** 2 / expected).sum()
    row = stats.chi_square_from_counts(table(spark, cells)).first()
    assert row.chi_square == pytest.approx(wanted)
    assert row.p_value == pytest.approx(np.exp(-wanted / 2))


def test_correction_never_overshoots(spark):
    row = stats.chi_square_from_counts(table(spark, [("f", "a", 10, 10), ("f", "b", 10, 10)])).first()
    assert (row.chi_square, row.p_value, row.cramers_v) == (0.0, pytest.approx(1.0), 0.0)


def test_degenerate_tables_have_no_association(spark):
    cells = [("one level", "a", 10, 10), ("one class", "a", 10, 0), ("one class", "b", 5, 0)]
    for row in stats.chi_square_from_counts(table(spark, cells)).collect():
        assert (row.chi_square, row.p_value, row.cramers_v) == (0.0, 1.0, 0.0)


def test_contingency_ignores_missing_levels(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (0, "a"), (0, None)], "future_aml_event int, c string")
    assert rows(stats.contingency(frame, ["c"])) == [("c", "a", 1, 1)]


def test_approximate_median_is_an_element(spark):
    frame = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 10.0)], "future_aml_event int, x double")
    assert stats.median_comparison(frame, ["x"]).first()["median_x"] == 2.0
