"""Customer risk review end to end.

Each stage is written before the next one reads it, so a lost executor costs a
stage at most and later stages read pruned columns instead of repeating joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from riskrank.models.additive import (
    Settings, additive_contributions, fit_additive, score_additive,
)
from riskrank.models import store
from riskrank.models.logistic import (
    fit_logistic, logistic_contributions, optimality, score_logistic, weights_of,
)
from riskrank.operators import (
    audit, behaviour, decide, evaluate, explain, mapping, prepare, profile, scorecard, stats,
    temporal,
)
from riskrank.operators.joins import hot_digests
from riskrank.session import materialise
from riskrank.sources.files import read_table, write_result_csv, write_table
from riskrank.sources.orders import Windows

# Fixed value: the windows of the published run.
PUBLISHED_WINDOWS = Windows("2022-09-01", "2022-09-07", "2022-09-08", "2022-09-10")

Keep = Callable[[str, DataFrame], DataFrame]


def keep_in_scratch(name: str, df: DataFrame) -> DataFrame:
    return materialise(df, name)


def keep_as_tables(prefix: str, fmt: str = "parquet") -> Keep:
    """Write stages under ``prefix``: a folder when it has a slash, else catalog names."""
    def keep(name: str, df: DataFrame) -> DataFrame:
        target = f"{prefix.rstrip('/')}/{name}" if "/" in prefix else f"{prefix}{name}"
        write_table(df, target, fmt)
        return read_table(df.sparkSession, target, fmt)

    return keep


def keep_as_bucketed_tables(prefix: str, buckets: int, key: str = "entity_id", folder: str | None = None,
                            fmt: str = "parquet") -> Keep:
    """Write stages as catalog tables, those with ``key`` dealt into ``buckets`` by it.

    Joins of two such tables on the key need no exchange. Tables with the key hold one row
    per customer, so no bucket grows beyond its share. ``folder`` places the tables, else
    the warehouse does.
    """
    def keep(name: str, df: DataFrame) -> DataFrame:
        dealt = df.repartition(buckets, key) if key in df.columns else df
        writer = dealt.write.format(fmt).mode("overwrite")
        if key in df.columns:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        if folder is not None:
            writer = writer.option("path", f"{folder.rstrip('/')}/{prefix}{name}")
        writer.saveAsTable(f"{prefix}{name}")
        return df.sparkSession.table(f"{prefix}{name}")

    return keep


@dataclass
class Review:
    """Stage tables and fitted models of one run."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)


def build_features(accounts_raw: DataFrame, transactions_raw: DataFrame, windows: Windows,
                   algo: str = "xxhash64", keep: Keep = keep_in_scratch) -> dict[str, DataFrame]:
    """Everything up to one feature row per customer."""
    t: dict[str, DataFrame] = {}
    t["customer_accounts"] = keep("customer_accounts", mapping.customer_accounts(accounts_raw))
    # Kept typed: the hot-key pass and the join then read columns instead of parsing the input twice.
    t["clean_transactions"] = keep(
        "clean_transactions", mapping.clean_transactions(transactions_raw))
    enriched = mapping.enrich_transactions(t["clean_transactions"], t["customer_accounts"])
    # In the order they come: an order by date would hold all wide rows of a task.
    t["enriched_transactions"] = keep("enriched_transactions", enriched)
    observation = temporal.within_dates(
        t["enriched_transactions"], windows.observation_start, windows.observation_end)
    outcome = temporal.within_dates(
        t["enriched_transactions"], windows.outcome_start, windows.outcome_end)
    observation = t["observation_transactions"] = keep("observation_transactions", observation)
    t["customer_target"] = keep("customer_target", temporal.customer_target(observation, outcome))
    t["customer_profiles"] = profile.customer_profiles(
        t["customer_accounts"], t["customer_target"], algo)
    t["customer_scorecard"] = keep(
        "customer_scorecard", scorecard.score_customers(t["customer_profiles"]))
    # Features read the observation window only: nothing of the outcome can leak in.
    events = behaviour.standardise_amounts(behaviour.directional_events(observation))
    hot = hot_digests(temporal.participants(observation), {"entity": ["entity_id"]})["entity"]
    t["customer_activity"] = keep("customer_activity", behaviour.customer_activity(events, hot))
    t["customer_features"] = keep("customer_features", behaviour.customer_features(
        t["customer_scorecard"], t["customer_activity"]))
    return t


def report_tables(review: Review, accounts_raw: DataFrame, transactions_raw: DataFrame,
                  dataset: str = "transactions") -> dict[str, DataFrame]:
    """The reports on a run's stage tables and models, evaluated when they are read."""
    t, models = review.tables, review.models
    frame, scored = t["model_frame"], t["model_scores"]
    test = evaluate.score_table(scored.filter("split = 'test'"), evaluate.ALL_MODELS)
    ranked = evaluate.ranked_scores(test)
    time_column = audit.find_time_column(transactions_raw)
    reports = {} if time_column is None else {
        "transaction_time_range": audit.time_range(transactions_raw, time_column)}
    return reports | {
        "audit_record": audit.audit_record(dataset, transactions_raw, accounts_raw),
        "label_distribution": audit.label_distribution(transactions_raw),
        "input_row_counts": audit.row_counts(
            {"transactions": transactions_raw, "accounts": accounts_raw}),
        "transaction_null_counts": audit.null_counts_long(transactions_raw),
        "mapping_summary": mapping.mapping_summary(t["enriched_transactions"]),
        "daily_profile": audit.daily_profile(t["enriched_transactions"]),
        "accounts_per_entity": mapping.accounts_per_entity(t["customer_accounts"]),
        "attribute_distribution": profile.attribute_distribution(t["customer_profiles"]),
        "rating_distribution": scorecard.rating_distribution(t["customer_scorecard"]),
        "rating_outcomes": scorecard.rating_outcomes(t["customer_scorecard"]),
        "top_high_risk": scorecard.top_high_risk(t["customer_scorecard"]),
        "feature_means": behaviour.feature_means(t["customer_features"]),
        "median_comparison": stats.median_comparison(t["customer_features"]),
        "precision_recall_curve": evaluate.precision_recall_curve(ranked),
        "probability_summary": evaluate.probability_summary(ranked),
        "calibration": evaluate.calibration(ranked),
        "metric_chart": evaluate.metric_chart(t["model_comparison"]),
        "case_explanation": explain.case_explanation(
            explain.top_true_positive(scored.filter("split = 'test'")),
            additive_contributions(scored, models["additive"])),
        "logistic_optimality": optimality(
            frame.filter("split = 'train'"), weights_of(models["logistic"])),
        "global_importance": explain.global_importance(
            frame.filter("split = 'train'"), models["additive"]),
        "additive_explanations": explain.local_explanation(
            additive_contributions(scored, models["additive"])),
        "logistic_explanations": explain.local_explanation(
            logistic_contributions(frame, models["logistic"])),
    }


def run_review(accounts_raw: DataFrame, transactions_raw: DataFrame,
               windows: Windows = PUBLISHED_WINDOWS, algo: str = "xxhash64",
               settings: Settings = Settings(), keep: Keep = keep_in_scratch) -> Review:
    """All stages, both tests, both models, the comparison, the decision and the reports."""
    review = Review(build_features(accounts_raw, transactions_raw, windows, algo, keep))
    t = review.tables
    features = t["customer_features"]
    t["numeric_statistical_tests"] = keep("numeric_statistical_tests", stats.numeric_tests(features))
    t["categorical_statistical_tests"] = keep(
        "categorical_statistical_tests", stats.categorical_tests(features))
    frame = keep("model_frame", prepare.stratified_split(prepare.model_frame(features), algo=algo))
    train = frame.filter("split = 'train'")
    review.models["logistic"] = fit_logistic(train)
    review.models["additive"] = fit_additive(train, settings=settings)
    scored = keep("model_scores", score_additive(
        score_logistic(frame, review.models["logistic"]), review.models["additive"]))
    t["model_frame"], t["model_scores"] = frame, scored
    # The models as tables: another session explains and scores with them without a fit.
    spark = frame.sparkSession
    t["additive_model"] = keep("additive_model", store.additive_table(spark, review.models["additive"]))
    t["logistic_model"] = keep(
        "logistic_model", store.logistic_table(spark, weights_of(review.models["logistic"])))
    t["model_test_predictions"] = keep(
        "model_test_predictions", evaluate.test_predictions(scored))
    t["model_comparison"] = keep("model_comparison", evaluate.model_comparison(
        evaluate.score_table(scored, evaluate.ALL_MODELS)))
    t["champion_decision"] = decide.champion_decision(t["model_comparison"])
    t.update(report_tables(review, accounts_raw, transactions_raw))
    return review


def export_reports(review: Review, folder: str,
                   names: tuple[str, ...] = ("model_comparison", "champion_decision")) -> None:
    """Write small reports as CSV, one folder each."""
    for name in names:
        write_result_csv(review.tables[name], f"{folder.rstrip('/')}/{name}")
