"""Canonical keys and reproducible hash assignment (Column -> Column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_bank(value: str | Column) -> Column:
    """Bank ids that read as integers lose padding and zeros; others are trimmed."""
    text = _col(value).cast("string")
    return F.coalesce(text.try_cast("bigint").cast("string"), F.trim(text))


def canonical_account(value: str | Column) -> Column:
    return F.upper(F.trim(_col(value).cast("string")))


def trimmed(value: str | Column) -> Column:
    return F.trim(_col(value))


def hash_number(key: str | Column, seed: int, algo: str = "xxhash64") -> Column:
    """A 64-bit (xxhash64) or 60-bit (md5) number that depends on key and seed only.

    md5 exists so that another engine can reproduce the assignment.
    """
    if algo == "xxhash64":
        return F.xxhash64(_col(key), F.lit(seed))
    if algo == "md5":
        return _md5_digits(key, seed, 15)
    raise ValueError(f"unknown hash algorithm {algo!r}")


def hash_bucket(key: str | Column, seed: int, buckets: int = 100, algo: str = "xxhash64") -> Column:
    """Reproducible bucket in ``[0, buckets)``."""
    if algo == "md5":
        return _md5_digits(key, seed, 8) % F.lit(buckets)
    return F.pmod(hash_number(key, seed, algo), F.lit(buckets))


def weighted_label(bucket: Column, shares: Sequence[tuple[str, int]]) -> Column:
    """Pick a label by cumulative share of a 0-based bucket; the last label takes the rest."""
    edges, running = [], 0
    for label, share in shares[:-1]:
        running += share
        edges.append((running, label))
    picked = F.lit(shares[-1][0])
    for edge, label in reversed(edges):
        picked = F.when(bucket < edge, label).otherwise(picked)
    return picked


def _md5_digits(key: str | Column, seed: int, digits: int) -> Column:
    text = F.concat_ws(":", _col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
