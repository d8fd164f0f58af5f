"""Stage tables shared by the registered queries of one Spark application.

A stage is written the first time a query needs it, from the given tables of
that folder, and read back by later queries - as a production run would do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.functions.maths import logistic
from riskrank.models.additive import fit_additive, score_additive
from riskrank.models import store
from riskrank.models.logistic import fit_logistic, score_logistic, weights_of
from riskrank.operators import behaviour, evaluate, mapping, prepare, profile, scorecard, temporal
from riskrank.operators.joins import hot_digests
from riskrank.schemas import ADDITIVE, LOGISTIC, SCORECARD
from riskrank.session import materialise, scratch_path
from riskrank.sources import orders

ALGO = "md5"  # reproducible in SQL; the library default is xxhash64

# Fixed weights of two stand-in models, so that evaluation can be replayed in SQL.
STAND_INS = {
    LOGISTIC: (-2.0, {"log_transaction_count": 0.35, "unusually_large_tx_ratio": 9.0,
                      "log_incoming_outgoing_ratio": -0.6, "cross_bank_ratio": -2.0}),
    ADDITIVE: (-2.5, {"log_counterparty_count": 0.3, "unusually_large_tx_ratio": 11.0,
                      "log_account_count": 0.25, "self_transfer_ratio": 3.0,
                      "cross_bank_ratio": -1.5}),
}

# Fixed weights of a stand-in explanation over all 19 inputs; a nominal input
# enters by the length of its value.
EXPLAINED_NUMERIC = {
    "log_transaction_count": 0.35,
    "log_counterparty_count": 0.3,
    "log_transactions_per_active_day": -0.2,
    "maximum_amount_zscore": 0.15,
    "cross_bank_ratio": -2.0,
    "self_transfer_ratio": 3.0,
    "unusually_large_tx_ratio": 9.0,
    "log_incoming_outgoing_ratio": -0.6,
    "log_account_count": 0.25,
    "log_bank_count": -0.45,
    "log_currency_count": 0.5,
    "log_payment_format_count": -0.1,
}
EXPLAINED_NOMINAL = {
    "customer_type": 0.02,
    "country_risk": -0.11,
    "pep_status": 0.07,
    "ubo_complexity": 0.05,
    "industry_risk": -0.03,
    "onboarding_channel": 0.04,
    "kyc_documentation": -0.06,
}


class Stages:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def accounts_raw(self) -> DataFrame:
        return orders.accounts_raw(self.spark, self.folder)

    @cached_property
    def transactions_raw(self) -> DataFrame:
        return orders.transactions_raw(self.spark, self.folder)

    @cached_property
    def accounts(self) -> DataFrame:
        return materialise(mapping.customer_accounts(self.accounts_raw), "accounts")

    @cached_property
    def transactions(self) -> DataFrame:
        return materialise(mapping.clean_transactions(self.transactions_raw), "transactions")

    @cached_property
    def enriched(self) -> DataFrame:
        return materialise(mapping.enrich_transactions(self.transactions, self.accounts), "enriched")

    @property
    def observation(self) -> DataFrame:
        w = orders.ORDER_WINDOWS
        return temporal.within_dates(self.enriched, w.observation_start, w.observation_end)

    @property
    def outcome(self) -> DataFrame:
        w = orders.ORDER_WINDOWS
        return temporal.within_dates(self.enriched, w.outcome_start, w.outcome_end)

    @cached_property
    def target(self) -> DataFrame:
        return materialise(temporal.customer_target(self.observation, self.outcome), "target")

    def profiles(self, algo: str = ALGO) -> DataFrame:
        return profile.customer_profiles(self.accounts, self.target, algo)

    @cached_property
    def scorecard(self) -> DataFrame:
        return materialise(scorecard.score_customers(self.profiles()), "scorecard")

    @property
    def events(self) -> DataFrame:
        return behaviour.directional_events(self.observation)

    @cached_property
    def standardised(self) -> DataFrame:
        return behaviour.standardise_amounts(self.events)

    @cached_property
    def hot_entities(self) -> dict[int, int]:
        sides = temporal.participants(self.observation)
        return hot_digests(sides, {"entity": ["entity_id"]})["entity"]

    @property
    def activity(self) -> DataFrame:
        return behaviour.customer_activity(self.standardised, self.hot_entities)

    @cached_property
    def features(self) -> DataFrame:
        return materialise(
            behaviour.customer_features(self.scorecard, self.activity), "features")

    @cached_property
    def frame(self) -> DataFrame:
        return materialise(
            prepare.stratified_split(prepare.model_frame(self.features), algo=ALGO), "frame")

    @property
    def train(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "train")

    @cached_property
    def logistic_fit(self):
        return fit_logistic(self.train)

    @cached_property
    def additive_fit(self):
        return fit_additive(self.train)

    @cached_property
    def model_scores(self) -> DataFrame:
        return materialise(score_additive(
            score_logistic(self.frame, self.logistic_fit), self.additive_fit), "model-scores")

    @cached_property
    def stored_additive(self):
        """The fitted model as another session would load it."""
        path = scratch_path(self.spark, "additive-model")
        store.save_model(store.additive_table(self.spark, self.additive_fit), path)
        return store.load_additive(self.spark, path)

    @cached_property
    def stored_logistic(self):
        path = scratch_path(self.spark, "logistic-model")
        store.save_model(store.logistic_table(self.spark, weights_of(self.logistic_fit)), path)
        return store.load_logistic(self.spark, path)

    @property
    def fitted_scores(self) -> DataFrame:
        return evaluate.score_table(self.model_scores, evaluate.ALL_MODELS)

    @property
    def stand_in_scores(self) -> DataFrame:
        """The frame with the scorecard score and two fixed-weight probabilities."""
        columns = {}
        for name, column in ((LOGISTIC, "logistic_probability"), (ADDITIVE, "ebm_probability")):
            intercept, weights = STAND_INS[name]
            margin = sum((F.col(c) * w for c, w in weights.items()), F.lit(intercept))
            columns[column] = F.round(logistic(margin), 6)
        return self.frame.withColumns(columns)

    @property
    def long_scores(self) -> DataFrame:
        return evaluate.score_table(self.stand_in_scores, {
            SCORECARD: "scorecard_score", LOGISTIC: "logistic_probability",
            ADDITIVE: "ebm_probability"})

    @property
    def test_scores(self) -> DataFrame:
        return self.long_scores.filter(F.col("split") == "test")

    @cached_property
    def ranked_test_scores(self) -> DataFrame:
        return evaluate.ranked_scores(self.test_scores)


_known: dict[tuple[str, str], Stages] = {}


def stages(spark: SparkSession, folder: str) -> Stages:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _known:
        _known[key] = Stages(spark, folder)
    return _known[key]
