"""Session construction and the shared scratch area.

Intermediate tables that several jobs read (value counts, model blocks, stage
outputs) are written as parquet under ``spark.checkpoint.dir``: the lineage is
cut, the data outlives any executor, and later readers still get column
pruning and row-group statistics.
"""

from __future__ import annotations

import gc
import math
import uuid

from pyspark.sql import DataFrame, SparkSession


_folder_where_unset: list[str] = []


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; anything else comes from ``conf``."""
    builder = (
        SparkSession.builder.master(master)
        .appName("riskrank")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_folder(path: str) -> None:
    """Folder for sessions that leave ``spark.checkpoint.dir`` unset, as tests and local runs do."""
    _folder_where_unset[:] = [path]


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's stage tables, below the shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or next(iter(_folder_where_unset), None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{shared.rstrip('/')}/riskrank/{spark.sparkContext.applicationId}"


def close_scratch(spark: SparkSession) -> None:
    """Remove this application's stage tables; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch area and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.__dict__["_scratch_path"] = path
    return stored


def release(*tables: DataFrame) -> None:
    """Remove stage tables that ``materialise`` returned and that nothing will read again.

    Shuffle files of finished jobs go when the driver's JVM notices that nothing refers to
    them, which a long iteration with a large heap may put off until disks are full. So
    the JVM is asked to look now.
    """
    for table in tables:
        spark, path = table.sparkSession, table.__dict__.get("_scratch_path")
        if path is None:
            raise ValueError("not a stage table")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def use_all_slots(scan: DataFrame) -> DataFrame:
    """Deal a scan's rows over all task slots when its files give fewer tasks than that.

    A table in one small file would otherwise keep everything up to the next
    shuffle on one core. Scans with enough splits, as any large table has, are
    returned as they are.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


def for_iterations(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """Fewer, fuller partitions for data that an iterative fit passes over many times.

    Small training sets would spend every pass on task overhead. No shuffle;
    frames whose partitions already hold that many rows stay as they are.
    """
    return df.coalesce(max(1, math.ceil(rows / rows_per_task)))
