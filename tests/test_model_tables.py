"""Cyclic steps, the certificate of the logistic fit, and models that go through their tables."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.models import additive, logistic, store
from riskrank.operators import explain

NUMERIC, NOMINAL = ["a", "b"], ["c"]
SMALL = additive.Settings(max_rounds=20, patience=8)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(11)
    n = 2000
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    c = rng.choice(["x", "y", "z"], n, p=[.6, .3, .1])
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - 1.2 * (a > 0.3) - 0.3 * b - 0.8 * (c == "z")))).astype(int)
    rows = [(f"E{i}", float(a[i]), float(b[i]), str(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(
        rows, "entity_id string, a double, b double, c string, future_aml_event int").repartition(3).cache()


@pytest.fixture(scope="module")
def weights(train):
    return logistic.weights_of(logistic.fit_logistic(train, NUMERIC, NOMINAL, tol=1e-10))


@pytest.fixture(scope="module")
def model(train):
    return additive.fit_additive(train, NUMERIC, NOMINAL, settings=SMALL)


@pytest.fixture(scope="module")
def odd(train):
    """Training rows beside NULLs, NaN, unseen levels and values on the cut points."""
    return train.select("a", "b", "c").limit(50).union(train.sparkSession.createDataFrame(
        [(None, None, None), (float("nan"), 1.0, "never"), (1e300, -1e300, "x"), (0.0, 2.0, "")],
        "a double, b double, c string"))


def test_certificate_holds_at_the_optimum_alone(train, weights):
    found = {r.term: r for r in logistic.optimality(train, weights).collect()}
    assert set(found) == {"a", "b", "c_x", "c_y", "c_z", "(intercept)"}
    assert all(r.at_optimum for r in found.values())
    pdf = train.toPandas()
    z = (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)
    p = train.select("a", weights.margin().alias("m")).toPandas().m
    gradient = ((1 / (1 + np.exp(-p)) - pdf.future_aml_event) * z).sum() + weights.coefficients["a"]
    assert found["a"].gradient == pytest.approx(gradient, abs=1e-6)
    moved = dataclasses.replace(weights, coefficients={**weights.coefficients, "a": weights.coefficients["a"] + 0.2})
    wrong = {r.term: r.at_optimum for r in logistic.optimality(train, moved).collect()}
    assert not wrong["a"]
    assert logistic.optimality(train.limit(0), weights).count() == 6


def test_logistic_weights_survive_their_table(spark, train, weights, tmp_path):
    store.save_model(store.logistic_table(spark, weights), str(tmp_path / "m"))
    loaded = store.load_logistic(spark, str(tmp_path / "m"))
    assert loaded == weights
    fit = logistic.fit_logistic(train, NUMERIC, NOMINAL, tol=1e-10)
    both = logistic.score_weights(logistic.score_logistic(train, fit), loaded, "again")
    assert both.agg(F.max(F.abs(F.col("again") - F.col("logistic_probability")))).first()[0] < 1e-9


def test_additive_model_survives_its_table(spark, train, model, odd, tmp_path, monkeypatch):
    store.save_model(store.additive_table(spark, model), str(tmp_path / "m"))
    loaded = store.load_additive(spark, str(tmp_path / "m"))
    assert loaded.terms == model.terms and loaded.intercept == model.intercept
    for limit in (256, 1):  # levels as a literal, then by a join
        monkeypatch.setattr(store, "LITERAL_LEVELS", limit)
        explained = store.explain_additive(additive.additive_contributions(odd, model, "fitted"), loaded)
        assert explained.columns == ["a", "b", "c", "fitted", "contributions"]
        rows = explained.collect()
        assert len(rows) == 54 and all(r.fitted == r.contributions for r in rows)
    scored = store.explain_additive(additive.score_additive(train, model), loaded)
    assert scored.agg(F.max(F.abs(
        store.additive_probability(loaded) - F.col("ebm_probability")))).first()[0] < 1e-12


def test_importance_of_the_stored_model(train, model):
    own = {r.feature: r.importance for r in store.importance(store.explain_additive(train, model)).collect()}
    for row in explain.global_importance(train, model).collect():
        assert own[row.feature] == pytest.approx(row.importance, abs=1e-12)


def test_terms_without_cuts_or_levels(spark):
    model = additive.AdditiveModel(0.5, [additive.Term("k", [], None, [0.0]), additive.Term("e", None, [], [])], [])
    loaded = store.additive_from_table(store.additive_table(spark, model))
    assert loaded == model
    df = spark.createDataFrame([(1.0, "x"), (None, None)], "k double, e string")
    assert {tuple(e["contribution"] for e in r.contributions)
            for r in store.explain_additive(df, loaded).collect()} == {(0.0, 0.0)}


def copies_of_one_input(spark):
    """Eight copies of one input: steps from a single gradient go eight times too far."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * (a > 0)))).astype(int)
    names = [f"x{i}" for i in range(8)]
    rows = [(f"E{i}", *[float(a[i])] * 8, int(y[i])) for i in range(1500)]
    schema = "entity_id string, " + ", ".join(f"{n} double" for n in names) + ", future_aml_event int"
    return spark.createDataFrame(rows, schema).repartition(2).cache(), names


def test_cyclic_steps_do_not_overshoot_on_equal_inputs(spark):
    train, names = copies_of_one_input(spark)
    fast = additive.Settings(max_rounds=12, learning_rate=0.5, bags=2)
    cyclic = additive.fit_additive(train, names, [], settings=fast)
    at_once = additive.fit_additive(train, names, [], settings=dataclasses.replace(fast, shared_cells=0))
    assert max(cyclic.losses) < min(at_once.losses)
    assert all(loss < first for loss, first in zip(cyclic.losses, cyclic.first_losses))


def test_cyclic_fit_is_no_worse_on_the_fixture(train):
    longer = additive.Settings(max_rounds=150)
    cyclic = additive.fit_additive(train, NUMERIC, NOMINAL, settings=longer)
    at_once = additive.fit_additive(train, NUMERIC, NOMINAL, settings=dataclasses.replace(longer, shared_cells=0))
    assert np.mean(cyclic.losses) <= np.mean(at_once.losses) + 1e-4


def test_shared_curvatures_are_those_of_the_rows():
    terms = [additive.Term("a", [0.5], None), additive.Term("b", None, ["x", "y"])]
    shared = additive.Shared.of(terms, 100)
    bins = np.array([[0, 1, 1, 0], [0, 1, 2, 1]], np.uint16)
    block = (bins, np.zeros(4, np.uint8), np.zeros(4, np.uint32))
    found = additive._block_shared(block, np.array([0, 3]), np.zeros((1, 6)), np.zeros(1), [0], shared)
    cells = found.reshape(3, 3) / additive.FIXED_POINT
    expected = np.zeros((3, 3))
    for i, j in bins.T:
        expected[i, j] += 0.25
    assert np.allclose(cells, expected)
    assert [(j, change.tolist()) for j, change in shared.after(0, np.array([1.0, 2.0]), cells.ravel())] == [
        (1, [0.25, 0.75])]
    assert additive.Shared.of(terms, 0).size == 0
