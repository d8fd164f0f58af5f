"""Both models on a small synthetic frame with known structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.models import additive, logistic
from riskrank.operators import explain, prepare
from riskrank.schemas import MODEL_NUMERIC, PROFILE_ATTRIBUTES, TESTED_NUMERIC

NUMERIC, NOMINAL = ["a", "b"], ["c"]
SMALL = additive.Settings(max_rounds=25, patience=8)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(7)
    n = 3000
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    c = rng.choice(["x", "y", "z"], n, p=[.6, .3, .1])
    margin = -1.5 + 1.2 * (a > 0.3) + 0.3 * b + 0.8 * (c == "z")
    y = (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)
    rows = [(f"E{i}", float(a[i]), float(b[i]), str(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(
        rows, "entity_id string, a double, b double, c string, future_aml_event int"
    ).repartition(4).cache()


@pytest.fixture(scope="module")
def fit(train):
    return logistic.fit_logistic(train, NUMERIC, NOMINAL, tol=1e-10)


@pytest.fixture(scope="module")
def model(train):
    return additive.fit_additive(train, NUMERIC, NOMINAL, settings=SMALL)


def test_logistic_is_optimal(train, fit):
    """The gradient of sum(loss) + |w|^2/2 vanishes at the solution."""
    pdf = train.toPandas()
    z = (pdf[NUMERIC] - pdf[NUMERIC].mean()) / pdf[NUMERIC].std(ddof=0)
    x = np.column_stack([z] + [(pdf.c == v).astype(float) for v in ("x", "y", "z")])
    w = np.array([fit.coefficients()[t] for t in ["a", "b", "c_x", "c_y", "c_z"]])
    p = 1 / (1 + np.exp(-(x @ w + fit.model.intercept)))
    gradient = x.T @ (p - pdf.future_aml_event) + w
    assert np.abs(gradient).max() < 1e-2 and abs((p - pdf.future_aml_event).sum()) < 1e-2


def test_logistic_contributions_add_up(train, fit):
    scored = logistic.logistic_contributions(logistic.score_logistic(train, fit), fit)
    total = F.aggregate("contributions", F.lit(fit.model.intercept),
                        lambda t, e: t + e["contribution"])
    logit = F.log(F.col("logistic_probability") / (1 - F.col("logistic_probability")))
    assert scored.agg(F.max(F.abs(total - logit))).first()[0] < 1e-9


def test_unseen_level_and_constant_column(spark, train, fit):
    odd = train.limit(1).withColumn("c", F.lit("never seen"))
    entry = {e["feature"]: e["contribution"]
             for e in logistic.logistic_contributions(odd, fit).first()["contributions"]}
    assert [entry[f"c_{v}"] for v in "xyz"] == [0.0, 0.0, 0.0]
    assert 0 < logistic.score_logistic(odd, fit).first()["logistic_probability"] < 1
    assert logistic.fit_scaling(train.withColumn("k", F.lit(2.0)), ["k"]).scale == {"k": 1.0}


def test_additive_contributions_add_up_and_are_centred(train, model):
    scored = additive.score_additive(train, model, keep_terms=True)
    total = F.aggregate("_terms", F.lit(model.intercept), lambda t, x: t + x)
    logit = F.log(F.col("ebm_probability") / (1 - F.col("ebm_probability")))
    row = scored.agg(F.max(F.abs(total - logit)), *[F.avg(F.col("_terms")[i]) for i in range(3)]).first()
    assert row[0] < 1e-9
    # Centring weighs rows once per bag that trained on them.
    assert max(abs(v) for v in row[1:]) < 0.02


def test_additive_finds_the_structure(model):
    terms = {t.name: t for t in model.terms}
    low = np.array([s for s, cut in zip(terms["a"].scores, [-9] + terms["a"].cuts) if cut < 0])
    high = np.array([s for s, cut in zip(terms["a"].scores, [-9] + terms["a"].cuts) if cut > 0.5])
    assert low.max() < high.min()
    assert terms["c"].levels == ["x", "y", "z"]
    assert terms["c"].scores[2] > max(terms["c"].scores[:2])


def test_additive_fit_is_reproducible(train, model):
    again = additive.fit_additive(train, NUMERIC, NOMINAL, settings=SMALL)
    moved = additive.fit_additive(train.repartition(7), NUMERIC, NOMINAL, settings=SMALL)
    assert again == model
    assert moved == model


def test_fit_of_many_rows_does_not_depend_on_partitions(spark):
    rows = spark.range(24_000).select(
        F.format_string("E%d", "id").alias("entity_id"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("b"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)).cast("string").alias("c")).withColumn(
        "future_aml_event", (F.pmod(F.xxhash64("entity_id"), F.lit(100)) < 5 + F.col("b") * 8).cast("int"))
    few = additive.Settings(max_rounds=6)
    one, other = (additive.fit_additive(rows.repartition(n), NUMERIC, NOMINAL, settings=few) for n in (2, 9))
    assert one == other


def test_cut_points_are_the_exact_quantiles(spark):
    values = [float(v * v % 1009) for v in range(5000)] + [3.0] * 2000
    df = spark.createDataFrame([(v, 1.0) for v in values] + [(None, None)], "a double, k double")
    ordered, n = sorted(values), len(values)
    expected = {ordered[-(-i * n // 64) - 1] for i in range(1, 64)}
    cuts = additive.cut_points(df, ["a", "k"], 64)
    assert cuts == {"a": sorted(expected), "k": [1.0]}


def test_many_levels_take_wider_bin_numbers():
    few = additive.Term("c", None, ["x"] * 65_535)
    many = additive.Term("c", None, ["x"] * 65_536)
    assert additive._bin_type([few]) is np.uint16 and additive._bin_type([few, many]) is np.uint32


def test_additive_unseen_level_contributes_nothing(train, model):
    odd = train.limit(1).withColumn("c", F.lit("never seen"))
    entries = additive.additive_contributions(odd, model).first()["contributions"]
    assert {e["feature"]: e["contribution"] for e in entries}["c"] == 0.0


def test_small_leaves_are_refused():
    g, h, n = np.array([9.0, -1.0]), np.array([2.0, 50.0]), np.array([19.0, 500.0])
    assert additive._best_cut(g, h, n, 20) == (0.0, 0)
    assert additive._best_cut(g, h, n, 19)[1] == 1


def test_global_importance_and_local_explanation(train, model):
    table = explain.global_importance(train, model).collect()
    assert {r.feature for r in table} == {"a", "b", "c"}
    assert [r.importance for r in table] == sorted((r.importance for r in table), reverse=True)
    local = explain.local_explanation(additive.additive_contributions(train, model), top=2)
    per = local.groupBy("entity_id").agg(
        F.collect_list("contribution").alias("c"), F.max("place").alias("n")).first()
    assert per.n == 2 and per.c == sorted(per.c)


def test_local_explanation_ties_go_by_name(spark):
    frame = spark.sql("""select 'E1' as entity_id, array(
        named_struct('feature', 'b', 'contribution', -1.0D),
        named_struct('feature', 'a', 'contribution', 1.0D),
        named_struct('feature', 'd', 'contribution', 0.2D),
        named_struct('feature', 'c', 'contribution', 1.0D)) as contributions""")
    got = [(r.place, r.feature) for r in explain.local_explanation(frame, top=2).collect()]
    assert got == [(1, "b"), (2, "a")]


def test_top_true_positive(spark):
    frame = spark.createDataFrame(
        [("E3", 1, .9), ("E2", 1, .9), ("E1", 0, .99)],
        "entity_id string, future_aml_event int, ebm_probability double")
    assert explain.top_true_positive(frame).first().entity_id == "E2"


def test_model_frame_transforms(spark):
    values = {c: 3.0 for c in TESTED_NUMERIC} | {
        "maximum_amount_zscore": 50.0, "cross_bank_ratio": float("inf"),
        "transaction_count": -4.0, "bank_count": None}
    row = ("E1", 1, 27, *values.values(), *[None] * len(PROFILE_ATTRIBUTES))
    schema = ("entity_id string, future_aml_event int, kyc_risk_score int, "
              + ", ".join(f"{c} double" for c in values)
              + ", " + ", ".join(f"{c} string" for c in PROFILE_ATTRIBUTES))
    got = prepare.model_frame(spark.createDataFrame([row], schema)).first().asDict()
    assert got["scorecard_score"] == 0.27
    assert got["maximum_amount_zscore"] == 10.0 and got["cross_bank_ratio"] == 0.0
    assert got["log_transaction_count"] == 0.0
    assert got["log_counterparty_count"] == pytest.approx(np.log1p(3))
    assert all(got[c] == "Unknown" for c in PROFILE_ATTRIBUTES)
    assert not {"kyc_risk_score", "kyc_risk_rating"} & set(got)
    assert set(MODEL_NUMERIC) <= set(got)


def test_split_shares_hold_in_every_class_whatever_the_partitioning(spark, rows):
    frame = spark.range(1000).select(
        F.concat(F.lit("E"), "id").alias("entity_id"),
        (F.col("id") % 10 == 0).cast("int").alias("future_aml_event"))
    split = prepare.stratified_split(frame)
    counts = {(r.split, r.future_aml_event): r["count"]
              for r in split.groupBy("split", "future_aml_event").count().collect()}
    assert counts == {("train", 0): 540, ("validation", 0): 180, ("test", 0): 180,
                      ("train", 1): 60, ("validation", 1): 20, ("test", 1): 20}
    assert rows(split) == rows(prepare.stratified_split(frame.repartition(9)))
    assert rows(split) != rows(prepare.stratified_split(frame, seed=7))
