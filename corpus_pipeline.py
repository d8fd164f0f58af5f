"""The corpus pipeline: toxicity, line dedup, near-dedup, secret redaction, packing.

Every stage reads what the stage before it wrote, as Parquet in the shared scratch
folder, and returns the columns of ``documents``; the last returns the packed
pieces. A row with a null text passes every stage and packs as an empty document;
an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.llm import line_dedup, near_dup, packing, secrets, toxicity
from riskrank.llm.common import DOCUMENT_COLUMNS, table
from riskrank.session import materialise

# Lines are counted over distinct texts: the copies that near_dedup links later are one page. On sf0.1, check_s
# and check_h body lines stand on at most 4.7 % of a host's texts, the repeated line on 8.6 % or more.
LINES = line_dedup.Boilerplate(ratio=0.05, by_text=True)


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, the length following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def boilerplate_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.drop_boilerplate(docs.select(*DOCUMENT_COLUMNS), LINES))


def one_near_duplicate_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs.select(*DOCUMENT_COLUMNS))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(secrets.redact(docs.select(*DOCUMENT_COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", boilerplate_lines_go),
    ("near_dedup", one_near_duplicate_stays),
    ("secrets", secrets_are_masked),
    ("packing", packed),
]

# SQL can state neither the fitted scores of the first stage nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
