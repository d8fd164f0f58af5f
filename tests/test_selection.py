"""Exact ranks by counting passes, against sorted lists; ordered totals cut more than once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.operators import prepare, selection
from riskrank.operators.ranked import running_totals
from riskrank.operators.selection import select_ranks, selected_quantiles

INF, NAN = float("inf"), float("nan")


def sample(seed, n):
    chance = random.Random(seed)
    kinds = [lambda: chance.gauss(0, 1), lambda: chance.expovariate(1) ** 20, lambda: 0.25, lambda: -1e300,
             lambda: float(chance.randint(0, 5)), lambda: chance.random() * 1e-300]
    return [chance.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("ordered, cuts", [(500_000, 1000), (40, 10)])
def test_ranks_of_all_kinds_of_values(spark, ordered, cuts):
    groups = {"a": sample(1, 900), "b": sample(2, 40), None: sample(3, 300), "one": [7.0], "ties": [2.0] * 200 + [1.0],
              "odd": [NAN, INF, -INF, 0.0, 1.0, NAN]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    positions = {"least": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "top": lambda n: n - 1,
                 "late": lambda n: F.floor(n * 0.97), "beyond": lambda n: n}
    got = {r.g: r for r in select_ranks(df, "g", "v", positions, ordered_rows=ordered, cuts=cuts).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        ordered_values = sorted(values, key=lambda x: (x != x, x))
        n = len(values)
        want = [ordered_values[i] for i in (0, n // 2, n - 1, int(n * 0.97))]
        assert [str(v) for v in got[g][1:5]] == [str(v) for v in want]
        assert got[g].beyond is None


def test_weighted_ranks_and_whole_numbers(spark):
    chance = random.Random(4)
    rows = [("g", chance.randint(0, 1 << 62), chance.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    spread = sorted(v for _, v, w in rows for _ in range(w))
    got = select_ranks(df, "g", "v", {"x": lambda n: F.lit(333), "y": lambda n: n - 2}, "w", ordered_rows=20, cuts=8)
    assert tuple(got.first())[1:] == (spread[333], spread[-2])


def test_quantiles_interpolate(spark):
    values = sample(5, 501)
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    asked = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = selected_quantiles(df, "g", "v", asked, ordered_rows=30, cuts=7).first()
    assert [got[c] for c in asked] == pytest.approx(np.quantile(values, list(asked.values())).tolist())
    assert selected_quantiles(df.limit(0), "g", "v", asked).count() == 0


def test_passes_bring_back_a_fixed_number_of_rows(spark, monkeypatch):
    """However many values there are, an interval's counts are at most two per cut."""
    sizes, real = [], selection._picked

    def picked(counted, order):
        if order == "_stretch":
            sizes.append(counted.count())
        return real(counted, order)

    monkeypatch.setattr(selection, "_picked", picked)
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.rand(1).alias("v"))
    select_ranks(df, "g", "v", {"x": lambda n: F.floor(n / 3)}, ordered_rows=100, cuts=20)
    assert sizes and max(sizes) <= 43


@pytest.mark.parametrize("most", [2])
def test_running_totals_of_ranges_cut_again(spark, monkeypatch, most):
    monkeypatch.setattr("riskrank.operators.ranked.ROWS_PER_BUCKET", 6)
    rows = [(g, float(v) if v % 7 else float(-v), v % 3 + 1) for g in ("x", None) for v in range(90)]
    counts = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): (r.n_before, r.n_total) for r in running_totals(
        counts, "g", "v", ["n"], most_buckets=most).collect()}
    assert len(got) == 180
    for g, v, _ in rows:
        assert got[g, v] == (sum(n for h, u, n in rows if h == g and u < v), sum(n for h, _, n in rows if h == g))


def test_split_is_the_same_by_selection(spark):
    """Every class is cut where its ordered draws reach the shares, equal draws on one side."""
    frame = spark.range(503).select(F.concat(F.lit("E"), F.col("id") % 400).alias("entity_id"),
                                    F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("int").alias("future_aml_event"))
    drawn = frame.withColumn("draw", prepare.hash_number("entity_id", prepare.SEED, "xxhash64")).collect()
    got = prepare.stratified_split(frame).collect()
    of = {(r.entity_id, r.future_aml_event): r.split for r in got}
    assert len(got) == 503
    for label in (0, 1, None):
        draws = sorted(r.draw for r in drawn if r.future_aml_event == label)
        for r in (x for x in drawn if x.future_aml_event == label):
            before = sum(d < r.draw for d in draws)
            want = "unlabelled" if label is None else "train" if before < len(draws) * 0.6 else \
                "validation" if before < len(draws) * 0.8 else "test"
            assert of[r.entity_id, label] == want
