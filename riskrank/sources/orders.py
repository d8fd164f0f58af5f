"""Raw accounts and transactions derived from TPC-H-style order tables.

Customers become sending accounts and suppliers receiving accounts. An entity
owns up to eight customer accounts and possibly a supplier account, so
self-transfers exist. Dirt is deliberate: padded ids, accounts missing from
the mapping, NULL amounts, exact duplicates, rare large amounts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.session import use_all_slots

CURRENCIES = ["USD", "EUR", "JPY", "GBP", "CNY"]
LEGAL_FORMS = ["Corporation", "Partnership", "Sole Proprietorship"]


@dataclass(frozen=True)
class Windows:
    """Inclusive calendar windows: features come from one, outcomes from the other."""

    observation_start: str
    observation_end: str
    outcome_start: str
    outcome_end: str


ORDER_WINDOWS = Windows("1995-01-01", "1999-12-31", "2000-01-01", "2000-12-31")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _entity_name(number: Column) -> Column:
    form = F.element_at(F.array(*map(F.lit, LEGAL_FORMS)), (number % 3 + 1).cast("int"))
    kind = F.when(number % 50 == 49, F.lit("Individual")).otherwise(form)
    return F.concat(kind, F.lit(" #"), number.cast("string"))


def _currency(nation: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CURRENCIES)), (nation % 5 + 1).cast("int"))


def _padded(nation: Column) -> Column:
    return F.lpad(nation.cast("string"), 4, "0")


def accounts_raw(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation").select("n_nationkey", "n_name")
    owner = F.floor(F.col("c_custkey") / 8).cast("bigint")
    senders = (
        _table(spark, folder, "customer")
        .filter(F.col("c_custkey") % 97 != 96)
        .select(
            F.col("c_nationkey").alias("n_nationkey"),
            _padded(F.col("c_nationkey")).alias("Bank ID"),
            F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("Account Number"),
            owner.alias("owner"),
        )
    )
    receivers = _table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"),
        F.col("s_nationkey").cast("string").alias("Bank ID"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("Account Number"),
        F.col("s_suppkey").cast("bigint").alias("owner"),
    )
    return (
        senders.unionByName(receivers)
        .join(nation, "n_nationkey")
        .select(
            F.concat(F.lit("Bank of "), "n_name").alias("Bank Name"),
            "Bank ID",
            "Account Number",
            F.concat(F.lit("E"), F.col("owner").cast("string")).alias("Entity ID"),
            _entity_name(F.col("owner")).alias("Entity Name"),
        )
    )


def transactions_raw(spark: SparkSession, folder: str) -> DataFrame:
    lines = use_all_slots(_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate"))
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = _table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")

    hot = F.floor(F.col("o_custkey") / 8) % 9 == 0
    draw = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 100
    scale = F.when(draw < F.when(hot, 10).otherwise(2), 100.0).otherwise(1.0)
    minute = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1440).cast("int")
    stamp = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)
    gross = F.col("l_extendedprice") * scale
    flagged = (
        (F.col("l_returnflag") == "R")
        & (F.col("l_discount") == 0.1)
        & (F.col("l_tax") >= F.when(hot, 0.03).otherwise(0.08))
    )
    # Every 500th order appears twice, as an exact copy.
    copies = F.when(F.col("l_orderkey") % 500 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))

    # Orders meet their customers first: they are fewer than the lines, which then are shuffled once.
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("copy", F.explode(copies))
        .select(
            F.date_format(stamp, "yyyy/MM/dd HH:mm").alias("Timestamp"),
            _padded(F.col("c_nationkey")).alias("From Bank"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("Account2"),
            F.col("s_nationkey").cast("string").alias("To Bank"),
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("Account4"),
            (gross * (1 - F.col("l_discount"))).alias("Amount Received"),
            _currency(F.col("s_nationkey")).alias("Receiving Currency"),
            F.when(F.col("l_orderkey") % 1000 != 7, gross).alias("Amount Paid"),
            _currency(F.col("c_nationkey")).alias("Payment Currency"),
            F.col("o_orderpriority").alias("Payment Format"),
            flagged.cast("int").alias("Is Laundering"),
        )
    )
