"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a null text being the empty one. Other columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_kept: dict[object, object] = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept by the Python worker under ``key`` for as long as its tasks are for that key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget_others(key: object = None) -> None:
    """Drop what earlier tasks left in this worker: Spark hands one worker to the tasks of all operators in turn."""
    for other in [k for k in _kept if k != key]:
        del _kept[other]


def by_batch(df: DataFrame, build: Callable[[pa.RecordBatch], dict], schema: str,
             rows: int | None = None, keeps: object = None) -> DataFrame:
    """Replace every Arrow batch, or every ``rows`` rows of it, by the columns that ``build`` returns for it.

    ``keeps``: the key of what ``build`` takes from ``kept_by_worker``.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        for batch in batches:
            step = rows or batch.num_rows
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step or 1)):
                made = build(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[n]) if not isinstance(made[n], pa.Array)
                                                  else made[n] for n in names], names)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style) over a whole array."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def lists(flat: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """Rows of equal width as an Arrow list column."""
    offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


class Strings:
    """Byte strings side by side, gathered by number."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``numbers`` joined, and where each ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.flat[at], ends
