"""Every registered query with a SQL twin must return the same rows as the twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.oracle import ORACLES
from checks.queries import REGISTRY
from compare import connect, difference

FOLDER = "/root/testdata/sf0.01"
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_only_fits_hashes_and_file_sizes_lack_a_twin():
    assert set(REGISTRY) - set(ORACLES) == {
        "profile_xxhash", "logistic_scores", "additive_scores",
        "fitted_model_comparison", "fitted_capacity_metrics", "fitted_calibration", "fitted_champion_decision",
        "fitted_case_explanation", "global_importance", "additive_local_contributions",
        "logistic_local_contributions"}
    assert set(ORACLES) <= set(REGISTRY) <= set(queries())
    assert set(TWINS) <= set(queries())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert difference(got, duck.execute(TWINS[name]).df()) is None


def test_entry_runs(spark):
    assert entry(spark).count() == 19
