"""File edges and the whole review on given tables."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from riskrank.models.additive import Settings
from riskrank.operators import mapping
from riskrank.models import store
from riskrank.plans import review
from riskrank.sources import files, orders

FOLDER = "/root/testdata/sf0.01"


def test_csv_header_with_repeated_names(spark, tmp_path):
    text = ("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,"
            "Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
            "2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0\n")
    path = tmp_path / "t.csv"
    path.write_text(text)
    row = mapping.clean_transactions(files.read_transactions(spark, str(path))).first()
    assert (row.from_bank_id, row.to_account, row.amount_paid) == ("10", "8000EBD30", 3697.34)
    assert str(row.transaction_timestamp) == "2022-09-01 00:20:00" and row.is_laundering == 0


def test_accounts_text_and_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nB,007,ab,E1,Corporation #1\n")
    (tmp_path / "p.txt").write_text("BEGIN\nline\n")
    accounts = mapping.clean_accounts(files.read_accounts(spark, str(tmp_path / "a.csv")))
    assert tuple(accounts.first()) == ("B", "7", "AB", "E1", "Corporation #1")
    assert files.read_patterns(spark, str(tmp_path / "p.txt")).count() == 2
    listed = files.file_inventory(spark, str(tmp_path)).collect()
    assert [r.file_name for r in listed] == ["a.csv", "p.txt"] and listed[1].size_bytes == 11


def test_overwrite_replaces_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.range(3), path)
    files.write_table(spark.range(2).select(F.col("id").cast("string").alias("name")), path)
    back = files.read_table(spark, path)
    assert back.columns == ["name"] and back.count() == 2
    files.write_table(spark.range(4), "stage_by_name")
    assert files.read_table(spark, "stage_by_name").count() == 4
    spark.sql("drop table stage_by_name")


def test_result_csv_preview_and_schema_rows(spark, tmp_path):
    files.write_result_csv(spark.range(3), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
    assert files.preview(spark.range(30)).count() == 10
    assert [tuple(r) for r in files.describe_schema(spark.range(1)).collect()] == [
        (0, "id", "bigint", False)]


def test_windows_reach_the_scan(spark):
    from checks.stages import stages

    plan = stages(spark, FOLDER).observation._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_date,1995-01-01)" in plan


@pytest.fixture(scope="module")
def inputs(spark):
    return orders.accounts_raw(spark, FOLDER), orders.transactions_raw(spark, FOLDER)


def test_outcomes_do_not_leak_into_features(inputs, rows):
    accounts, transactions = inputs
    late = F.col("Timestamp") >= "2000/01/01"
    changed = transactions.withColumns({
        "Amount Paid": F.when(late, F.lit(9e9)).otherwise(F.col("Amount Paid")),
        "Is Laundering": F.when(late, F.lit(0)).otherwise(F.col("Is Laundering"))})
    one = review.build_features(accounts, transactions, orders.ORDER_WINDOWS)["customer_features"]
    two = review.build_features(accounts, changed, orders.ORDER_WINDOWS)["customer_features"]
    drop = ["future_aml_event", "reason_codes"]
    shown = [F.round(c, 9) if t == "double" else F.col(c)
             for c, t in one.drop(*drop).dtypes]
    assert rows(one.select(*shown)) == rows(two.select(*shown))
    assert one.filter("future_aml_event = 1").count() == 32
    assert two.filter("future_aml_event = 1").count() == 0


def test_whole_review(inputs, tmp_path):
    result = review.run_review(
        *inputs, windows=orders.ORDER_WINDOWS, settings=Settings(max_rounds=3),
        keep=review.keep_as_tables(str(tmp_path)))
    tables = result.tables
    assert tables["model_comparison"].count() == 3
    assert tables["model_test_predictions"].count() == tables["model_frame"].filter(
        "split = 'test'").count()
    assert tables["numeric_statistical_tests"].count() == 12
    assert tables["categorical_statistical_tests"].count() == 8
    assert tables["champion_decision"].first().champion is not None
    assert (tmp_path / "customer_features" / "_SUCCESS").exists()
    assert (tmp_path / "clean_transactions" / "_SUCCESS").exists()
    assert tables["mapping_summary"].count() == 1
    assert tables["attribute_distribution"].count() > 7
    assert tables["feature_means"].count() == 2
    assert {r.model for r in tables["calibration"].select("model").distinct().collect()} == {
        r.model for r in tables["model_comparison"].collect()}
    assert tables["global_importance"].count() == 12
    customers = tables["model_frame"].count()
    assert tables["additive_explanations"].count() == 10 * customers
    assert tables["logistic_explanations"].count() == 10 * customers
    assert tables["audit_record"].count() == tables["transaction_time_range"].count() == 1
    assert tables["label_distribution"].count() == 2
    assert 0 < tables["accounts_per_entity"].count() <= 20 and tables["top_high_risk"].count() <= 20
    assert tables["metric_chart"].count() == 9
    case = tables["case_explanation"].collect()
    best = tables["model_scores"].filter("split = 'test' and future_aml_event = 1").orderBy(
        "ebm_probability", ascending=False).first()
    assert len(case) == 10 and {r.entity_id for r in case} <= {
        r.entity_id for r in tables["model_scores"].filter(
            f"ebm_probability = {best.ebm_probability!r}D").collect()}
    assert tables["logistic_optimality"].filter("not at_optimum").count() == 0
    loaded = store.additive_from_table(tables["additive_model"])
    assert loaded.terms == result.models["additive"].terms
    review.export_reports(result, str(tmp_path / "reports"))
    assert (tmp_path / "reports" / "model_comparison" / "_SUCCESS").exists()


def test_published_windows_are_the_default():
    assert dataclasses.astuple(review.PUBLISHED_WINDOWS) == (
        "2022-09-01", "2022-09-07", "2022-09-08", "2022-09-10")


def test_customer_joins_of_bucketed_tables_need_no_exchange(spark, tmp_path):
    keep = review.keep_as_bucketed_tables("bucketed_", 4, folder=str(tmp_path))
    customers = spark.range(3000).select(F.concat(F.lit("E"), "id").alias("entity_id"), F.col("id").alias("score"))
    activity = customers.where("score % 3 > 0").select("entity_id", (F.col("score") * 2).alias("n"))
    kept = [keep("scorecard", customers), keep("activity", activity)]
    keep("no_key", spark.range(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kept[0].join(kept[1], "entity_id", "left")
        assert joined.where("n is not null").count() == 2000
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("scorecard", "activity", "no_key"):
            spark.sql(f"drop table bucketed_{name}")
