"""One registered query per operator or operator family; doubles are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.stages import EXPLAINED_NOMINAL, EXPLAINED_NUMERIC, Stages, stages
from riskrank.models.additive import additive_contributions
from riskrank.models import store
from riskrank.models.logistic import (
    fit_scaling, logistic_contributions, optimality, scaled_inputs, score_weights, weights_of,
)
from riskrank.operators import (
    audit, behaviour, decide, evaluate, explain, mapping, prepare, profile, scorecard, stats,
    temporal,
)
from riskrank.schemas import MODEL_NUMERIC, TX_RAW
from riskrank.session import scratch_path
from riskrank.sources import files

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(build: Callable[[Stages], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(stages(spark, folder))

    REGISTRY[build.__name__] = run
    return build


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column so that engines agree on the last place shown."""
    doubles = [f.name for f in df.schema.fields
               if f.dataType.simpleString() == "double" and f.name not in keep]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# Sources and sinks

@register
def csv_transactions(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "csv-transactions")
    s.transactions_raw.write.csv(path, header=True)
    read = files.read_transactions(s.spark, path)
    return rounded(read.groupBy("Payment Format", "Payment Currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Amount Received").alias("received"),
        F.sum("Is Laundering").alias("labelled"), F.min("Timestamp").alias("first_seen")), 2)


@register
def csv_quarantine(s: Stages) -> DataFrame:
    """A transactions file in which some customers' amounts are no numbers and other customers' lines break off."""
    path = scratch_path(s.spark, "csv-faulty")
    raw = s.transactions_raw
    number = F.substring("Account2", 2, 20).cast("bigint")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns]
    amount = raw.columns.index("Amount Received")
    cells[amount] = F.when(number % 17 == 0, F.lit("n/a")).otherwise(cells[amount])
    lines = F.when(number % 23 == 0, F.concat_ws(",", *cells[:4])).otherwise(F.concat_ws(",", *cells))
    raw.select(lines.alias("value")).write.text(path)
    good, bad = files.read_checked(s.spark, path, TX_RAW, header=False)
    return files.quarantine_summary(good, bad)


@register
def csv_accounts(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "csv-accounts")
    s.accounts_raw.write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                             ignoreTrailingWhiteSpace=False)
    return files.read_accounts(s.spark, path)


@register
def text_lines(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "text")
    lines = s.accounts_raw.select(F.concat_ws(" -> ", "Entity ID", "Bank ID").alias("value"))
    lines.write.text(path)
    return files.read_patterns(s.spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register
def table_overwrite(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "table")
    files.write_table(s.target, path)
    replaced = s.enriched.select("transaction_date", "payment_currency", "is_laundering")
    files.write_table(replaced, path)
    return files.read_table(s.spark, path).groupBy("payment_currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("labelled"),
        F.max("transaction_date").alias("last_day"))


@register
def result_csv(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "result-csv")
    files.write_result_csv(audit.label_distribution(s.enriched), path)
    return s.spark.read.csv(path, header=True, schema="label int, n bigint, percentage double")


# Audit

@register
def input_row_counts(s: Stages) -> DataFrame:
    return audit.row_counts({"transactions": s.transactions_raw, "accounts": s.accounts_raw})


@register
def audit_label_distribution(s: Stages) -> DataFrame:
    raw = s.transactions_raw
    label = audit.find_label_column(raw)
    return audit.label_distribution(raw).withColumnRenamed(label, "label")


@register
def audit_time_range(s: Stages) -> DataFrame:
    raw = s.transactions_raw
    return audit.time_range(raw, audit.find_time_column(raw))


@register
def audit_null_counts(s: Stages) -> DataFrame:
    return audit.null_counts_long(s.transactions_raw)


@register
def audit_record(s: Stages) -> DataFrame:
    return audit.audit_record("orders", s.transactions_raw, s.accounts_raw)


@register
def ambiguous_accounts(s: Stages) -> DataFrame:
    return mapping.ambiguous_keys(
        mapping.clean_accounts(s.accounts_raw), mapping.ACCOUNT_KEY, "entity_id")


@register
def ambiguous_banks(s: Stages) -> DataFrame:
    return mapping.ambiguous_keys(
        mapping.clean_accounts(s.accounts_raw), ["bank_id"], "entity_id")


@register
def customer_accounts(s: Stages) -> DataFrame:
    return mapping.customer_accounts(s.accounts_raw)


@register
def mapping_summary(s: Stages) -> DataFrame:
    return mapping.mapping_summary(mapping.enrich_transactions(s.transactions, s.accounts))


@register
def accounts_per_entity(s: Stages) -> DataFrame:
    return mapping.accounts_per_entity(s.accounts)


@register
def daily_profile(s: Stages) -> DataFrame:
    return audit.daily_profile(s.enriched)


# Cleaning, joins, windows, target

@register
def clean_accounts(s: Stages) -> DataFrame:
    return mapping.clean_accounts(s.accounts_raw)


@register
def clean_transactions(s: Stages) -> DataFrame:
    return rounded(mapping.clean_transactions(s.transactions_raw), 4)


@register
def enriched_transactions(s: Stages) -> DataFrame:
    return rounded(mapping.enrich_transactions(s.transactions, s.accounts), 4)


@register
def observation_transactions(s: Stages) -> DataFrame:
    return rounded(s.observation, 4)


@register
def population(s: Stages) -> DataFrame:
    return temporal.population(s.observation)


@register
def future_positives(s: Stages) -> DataFrame:
    return temporal.future_positives(s.outcome)


@register
def population_target(s: Stages) -> DataFrame:
    return temporal.customer_target(s.observation, s.outcome)


@register
def target_summary(s: Stages) -> DataFrame:
    return temporal.target_summary(temporal.customer_target(s.observation, s.outcome))


# Profile and scorecard

@register
def profile_base(s: Stages) -> DataFrame:
    return profile.profile_base(s.accounts, s.target)


@register
def profile_md5(s: Stages) -> DataFrame:
    return s.profiles("md5")


@register
def profile_xxhash(s: Stages) -> DataFrame:
    return s.profiles("xxhash64")


@register
def customer_type_counts(s: Stages) -> DataFrame:
    return profile.type_counts(s.profiles())


@register
def attribute_distribution(s: Stages) -> DataFrame:
    return profile.attribute_distribution(s.profiles())


@register
def scorecard_points(s: Stages) -> DataFrame:
    return scorecard.score_customers(s.profiles()).drop("reason_codes")


@register
def reason_codes(s: Stages) -> DataFrame:
    return scorecard.score_customers(s.profiles()).select(
        "entity_id", F.array_join("reason_codes", "|").alias("reason_codes"))


@register
def rating_distribution(s: Stages) -> DataFrame:
    return scorecard.rating_distribution(s.scorecard)


@register
def rating_outcomes(s: Stages) -> DataFrame:
    return scorecard.rating_outcomes(s.scorecard)


@register
def top_high_risk(s: Stages) -> DataFrame:
    return scorecard.top_high_risk(s.scorecard).withColumn(
        "reason_codes", F.array_join("reason_codes", "|"))


# Behaviour

@register
def transaction_ids(s: Stages) -> DataFrame:
    ids = behaviour.with_transaction_id(s.observation)
    copies = ids.groupBy("transaction_id", "payment_format").agg(F.count(F.lit(1)).alias("copies"))
    return copies.groupBy("payment_format").agg(
        F.sum("copies").alias("n"), F.count(F.lit(1)).alias("distinct_ids"),
        F.max("copies").alias("most_copies"))


@register
def directional_events(s: Stages) -> DataFrame:
    return rounded(s.events.drop("transaction_id"), 4)


@register
def currency_statistics(s: Stages) -> DataFrame:
    return rounded(behaviour.currency_statistics(s.events))


@register
def amount_zscore(s: Stages) -> DataFrame:
    return rounded(s.standardised.select(
        "entity_id", "transaction_date", "direction", "currency", "amount_zscore",
        "is_cross_bank", "is_self_transfer"), 4)


@register
def customer_activity(s: Stages) -> DataFrame:
    return rounded(s.activity)


@register
def customer_features(s: Stages) -> DataFrame:
    joined = behaviour.customer_features(s.scorecard, s.activity)
    return rounded(joined.withColumn("reason_codes", F.array_join("reason_codes", "|")))


@register
def feature_means(s: Stages) -> DataFrame:
    return behaviour.feature_means(s.features)


# Statistics

@register
def median_comparison(s: Stages) -> DataFrame:
    return rounded(stats.median_comparison(s.features))


@register
def mann_whitney(s: Stages) -> DataFrame:
    return rounded(stats.numeric_tests(s.features))


@register
def effect_labels(s: Stages) -> DataFrame:
    tests = stats.numeric_tests(s.features)
    return tests.select(
        "feature", stats.effect_label(F.col("rank_biserial_effect")).alias("effect_size"))


@register
def contingency_tables(s: Stages) -> DataFrame:
    return stats.contingency(s.features)


@register
def chi_square(s: Stages) -> DataFrame:
    return rounded(stats.categorical_tests(s.features))


# Model preparation and models

@register
def model_frame(s: Stages) -> DataFrame:
    return rounded(prepare.model_frame(s.features))


@register
def stratified_split(s: Stages) -> DataFrame:
    frame = prepare.model_frame(s.features).select("entity_id", "future_aml_event")
    return prepare.stratified_split(frame, algo="md5")


@register
def split_summary(s: Stages) -> DataFrame:
    return prepare.split_summary(s.frame)


@register
def standard_scaling(s: Stages) -> DataFrame:
    scaling = fit_scaling(s.train, MODEL_NUMERIC)
    return rounded(s.frame.select(
        "entity_id", *[scaling.column(c).alias(c) for c in MODEL_NUMERIC]), 4)


@register
def one_hot_inputs(s: Stages) -> DataFrame:
    fit = s.logistic_fit
    encoded = fit.encoder.transform(scaled_inputs(s.frame, fit.scaling, fit.numeric))
    inputs = vector_to_array("_inputs")
    entries = F.array(*[
        F.struct(F.lit(name).alias("term"), inputs[i].alias("value"))
        for i, name in enumerate(fit.terms) if name not in fit.numeric
    ])
    return encoded.select("entity_id", F.inline(entries)).filter(F.col("value") != 0)


@register
def logistic_scores(s: Stages) -> DataFrame:
    return s.model_scores.select(
        "entity_id", "split", "future_aml_event", "logistic_probability")


@register
def additive_scores(s: Stages) -> DataFrame:
    return s.model_scores.select("entity_id", "split", "future_aml_event", "ebm_probability")


# Fits, certified without fitting again, and models that went through their tables

NEAR = 1e-9


@register
def logistic_optimality(s: Stages) -> DataFrame:
    """Whether the objective's gradient vanishes, term by term."""
    return optimality(s.train, weights_of(s.logistic_fit)).select("term", "at_optimum")


@register
def logistic_balance(s: Stages) -> DataFrame:
    """A free intercept makes the probabilities of the training rows add up to their positives."""
    return s.model_scores.filter(F.col("split") == "train").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.sum("logistic_probability"), 1).alias("expected_positives"))


@register
def logistic_margins(s: Stages) -> DataFrame:
    """Whether the weights read back from their table give the fit's probability, and their terms its log-odds."""
    weights = s.stored_logistic
    scored = logistic_contributions(score_weights(s.model_scores, weights, "reloaded"), weights)
    total = F.aggregate("contributions", F.lit(weights.intercept), lambda t, x: t + x["contribution"])
    odds = F.log(F.col("logistic_probability") / (1 - F.col("logistic_probability")))
    return scored.select("entity_id", "split", (
        (F.abs(F.col("reloaded") - F.col("logistic_probability")) < NEAR)
        & (F.abs(total - odds) < 1e-6)).alias("agrees"))


@register
def additive_fit_checks(s: Stages) -> DataFrame:
    """Hold-out loss in no bag above that of the intercept alone; terms centred on the rows the bags trained on."""
    model = s.additive_fit
    explained = store.explain_additive(s.train, s.stored_additive)
    means = explained.select(F.inline("contributions")).groupBy("feature").agg(
        F.avg("contribution").alias("mean"), F.max(F.abs("contribution")).alias("most"))
    learnt = all(best <= first for best, first in zip(model.losses, model.first_losses))
    return means.select(
        F.col("feature").alias("subject"),
        (F.abs("mean") <= 0.05 * F.greatest("most", F.lit(NEAR))).alias("holds")).union(
        s.spark.createDataFrame([("hold-out loss", learnt)], "subject string, holds boolean"))


@register
def additive_margins(s: Stages) -> DataFrame:
    """Whether the terms read back from the model's table add up to the fit's log-odds."""
    explained = store.explain_additive(s.model_scores, s.stored_additive)
    odds = F.log(F.col("ebm_probability") / (1 - F.col("ebm_probability")))
    return explained.select("entity_id", "split", (
        F.abs(store.additive_margin(s.stored_additive) - odds) < 1e-6).alias("agrees"))


@register
def importance_agreement(s: Stages) -> DataFrame:
    """Whether mean absolute contributions of the stored model equal the importance of the fitted one."""
    own = store.importance(store.explain_additive(s.train, s.stored_additive))
    fitted = explain.global_importance(s.train, s.additive_fit, top=None).withColumnRenamed("importance", "fitted")
    return own.join(fitted, "feature").select(
        "feature", (F.abs(F.col("importance") - F.col("fitted")) < NEAR).alias("agrees"))


@register
def fitted_model_comparison(s: Stages) -> DataFrame:
    return evaluate.model_comparison(evaluate.score_table(s.model_scores, evaluate.ALL_MODELS))


@register
def fitted_capacity_metrics(s: Stages) -> DataFrame:
    validation = s.fitted_scores.filter(F.col("split") == "validation")
    test = s.fitted_scores.filter(F.col("split") == "test")
    return evaluate.capacity_metrics(test, evaluate.capacity_threshold(validation))


@register
def fitted_calibration(s: Stages) -> DataFrame:
    return evaluate.calibration(evaluate.ranked_scores(s.fitted_scores.filter(F.col("split") == "test")))


@register
def fitted_champion_decision(s: Stages) -> DataFrame:
    return decide.champion_decision(evaluate.model_comparison(s.fitted_scores))


@register
def fitted_case_explanation(s: Stages) -> DataFrame:
    """The strongest terms of the test customer whom the additive model ranks first among the positives."""
    test = s.model_scores.filter(F.col("split") == "test")
    return explain.case_explanation(
        explain.top_true_positive(test), additive_contributions(s.frame, s.additive_fit))


# Evaluation, on fixed-weight stand-in models

@register
def capacity_threshold_stand_in(s: Stages) -> DataFrame:
    validation = s.long_scores.filter(F.col("split") == "validation")
    return rounded(evaluate.capacity_threshold(validation))


@register
def capacity_metrics_stand_in(s: Stages) -> DataFrame:
    validation = s.long_scores.filter(F.col("split") == "validation")
    return rounded(evaluate.capacity_metrics(
        s.test_scores, evaluate.capacity_threshold(validation)))


@register
def curve_areas_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.curve_areas(s.ranked_test_scores))


@register
def pr_curve_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.precision_recall_curve(s.ranked_test_scores))


@register
def prevalence_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.prevalence(s.test_scores))


@register
def probability_summary_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.probability_summary(s.ranked_test_scores))


@register
def calibration_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.calibration(s.ranked_test_scores))


@register
def model_comparison_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.model_comparison(s.long_scores))


@register
def metric_chart_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.metric_chart(evaluate.model_comparison(s.long_scores)))


@register
def test_predictions_stand_in(s: Stages) -> DataFrame:
    return rounded(evaluate.test_predictions(s.stand_in_scores))


# Explanation and decision

@register
def global_importance(s: Stages) -> DataFrame:
    return explain.global_importance(s.train, s.additive_fit)


@register
def top_true_positive_stand_in(s: Stages) -> DataFrame:
    test = s.stand_in_scores.filter(F.col("split") == "test")
    return explain.top_true_positive(test).select("entity_id", "ebm_probability")


@register
def local_explanation_stand_in(s: Stages) -> DataFrame:
    """Strongest ten of 19 fixed-weight terms for every customer."""
    terms = [(c, F.col(c) * w) for c, w in EXPLAINED_NUMERIC.items()]
    terms += [(c, F.length(c) * w) for c, w in EXPLAINED_NOMINAL.items()]
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(value, 6).alias("contribution"))
        for c, value in terms
    ])
    return explain.local_explanation(s.frame.select("entity_id", entries.alias("contributions")))


@register
def additive_local_contributions(s: Stages) -> DataFrame:
    return explain.local_explanation(additive_contributions(s.frame, s.additive_fit))


@register
def logistic_local_contributions(s: Stages) -> DataFrame:
    return explain.local_explanation(logistic_contributions(s.frame, s.logistic_fit))


@register
def champion_decision_stand_in(s: Stages) -> DataFrame:
    return rounded(decide.champion_decision(evaluate.model_comparison(s.long_scores)))
