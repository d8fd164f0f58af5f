"""Scans and sinks: CSV and text edges, file inventory, stage tables, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskrank.schemas import ACC_RAW, TX_RAW
from riskrank.session import materialise

UNREADABLE = "_unreadable"


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions; columns are taken by position because a header repeats."""
    return _read_csv(spark, path, TX_RAW)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, ACC_RAW)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Annotated pattern examples, one line per row, unparsed."""
    return spark.read.text(path)


def _read_csv(spark, path, schema):
    # enforceSchema ignores the header names: the file spells one of them twice.
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def read_checked(spark: SparkSession, path: str, schema: StructType, aside: str | None = None,
                 header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, (file_name, line) of those that do not), each line of the CSV being in one of them.

    A plain scan turns what does not parse into NULL without a trace. Here a line with a
    field that is not of its type, or with too few or too many fields, goes aside whole
    and is counted by ``quarantine_summary``; with ``aside`` it is appended to that folder.
    Empty fields are NULL and parse. The file is read once and kept as a stage table.
    """
    marked = StructType([*schema.fields, StructField(UNREADABLE, StringType())])
    scan = spark.read.csv(path, schema=marked, header=header, enforceSchema=True, mode="PERMISSIVE",
                          columnNameOfCorruptRecord=UNREADABLE)
    held = materialise(scan.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)), "checked-scan")
    bad = held.filter(F.col(UNREADABLE).isNotNull()).select(
        F.col("_file").alias("file_name"), F.col(UNREADABLE).alias("line"))
    if aside is not None:
        bad.write.mode("append").parquet(aside)
    return held.filter(F.col(UNREADABLE).isNull()).select(*[f.name for f in schema.fields]), bad


def quarantine_summary(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(rows_read, rows_parsed, rows_quarantined), one row."""
    counted = good.select(F.lit(1).alias("parsed")).union(bad.select(F.lit(0)))
    return counted.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("parsed") == 1).alias("rows_parsed"),
                       F.count_if(F.col("parsed") == 0).alias("rows_quarantined"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and path of every file below ``path``; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("size_bytes"),
            "path",
        )
        .orderBy("file_name")
    )


def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet") -> DataFrame:
    """A stage table by path (anything with a slash) or by catalog name."""
    if "/" in name_or_path:
        return spark.read.format(fmt).load(name_or_path)
    return spark.table(name_or_path)


def write_table(df: DataFrame, name_or_path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Replace a stage table, schema included."""
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name_or_path:
        writer.save(name_or_path)
    else:
        writer.saveAsTable(name_or_path)


def write_result_csv(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """Export a report (one row per model or per bin) as a single CSV part.

    One task writes the part, so more than ``most_rows`` rows are an error; write
    such a table with ``write_table``.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows are no report; use write_table")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def rows_to_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table such as a rule list."""
    return spark.createDataFrame(rows, schema)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def describe_schema(df: DataFrame) -> DataFrame:
    """The schema as rows: position, column name, type, nullability."""
    fields = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return rows_to_table(
        df.sparkSession, fields, "position int, column_name string, data_type string, nullable boolean")
