"""Boilerplate lines by site-relative frequency, in column functions only.

A line is boilerplate on a host when at least ``ratio`` of the host's pages
contain it, and at least ``least_pages`` of them do. Lines are compared without
the white space at their ends; blank lines are never counted or dropped.

A page is a row, or with ``by_text`` a distinct text of the host: copies of one
text are then one page and cannot mark the lines of their own body.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.session import materialise

BLANK = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


@dataclass(frozen=True)
class Boilerplate:
    ratio: float = 0.1
    least_pages: int = 3
    by_text: bool = False


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    trimmed = F.regexp_replace(line, BLANK, "")
    return F.when(trimmed != "", F.xxhash64(trimmed))


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(_lines(text), _digest)))


def page_lines(df: DataFrame, id_col: str, host: Column, text_col: str) -> DataFrame:
    """(page, host, line): one row per page and distinct non-blank line, the line as a 64-bit digest."""
    return df.select(F.col(id_col).alias("page"), host.alias("host"),
                     F.explode(_distinct_lines(F.col(text_col))).alias("line"))


def _host_texts(df: DataFrame, host: Column, text_col: str) -> DataFrame:
    """(host, page, lines): one row per host and distinct text, both as digests; a null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (df.select(host.alias("host"), F.xxhash64(text).alias("page"), _distinct_lines(text).alias("lines"))
            .groupBy("host", "page").agg(F.first("lines").alias("lines")))


def boilerplate_lines(df: DataFrame, how: Boilerplate = Boilerplate(), id_col: str = "doc_id",
                      host: Column | None = None, text_col: str = "text") -> DataFrame:
    """(host, line, pages, host_pages) of every boilerplate line. Rows with a null host form one host.

    Rows that repeat an id count as the pages they are: one each, or one per text with ``by_text``.
    """
    host = F.coalesce(F.col("source") if host is None else host, F.lit(""))
    if how.by_text:
        texts = materialise(_host_texts(df, host, text_col), "host_texts")
        found = texts.select("host", F.explode("lines").alias("line"))
        totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    else:
        found = page_lines(df, id_col, host, text_col)
        totals = df.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    pages = found.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")) \
        .where(F.col("pages") >= how.least_pages)
    return pages.join(totals, "host").where(F.col("pages") >= how.ratio * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, how: Boilerplate = Boilerplate(), id_col: str = "doc_id",
                     host: Column | None = None, text_col: str = "text",
                     removed_col: str | None = None) -> DataFrame:
    """``df`` with the boilerplate lines of each row's host taken out of its text; every row stays.

    Texts without such lines, null ones included, are unchanged. ``removed_col``
    adds the number of lines taken out. Hits are gathered per (id, host), so rows
    that repeat an id on one host share them.
    """
    host = F.coalesce(F.col("source") if host is None else host, F.lit(""))
    marked = materialise(boilerplate_lines(df, how, id_col, host, text_col), "boilerplate")
    hits = (page_lines(df, id_col, host, text_col).join(marked.select("host", "line"), ["host", "line"])
            .groupBy(F.col("page").alias("_hit_page"), F.col("host").alias("_hit_host"))
            .agg(F.collect_set("line").alias("_hit_lines")))
    joined = df.join(hits, F.col(id_col).eqNullSafe(F.col("_hit_page")) & (host == F.col("_hit_host")), "left")
    kept = F.filter(_lines(F.col(text_col)),
                    lambda line: ~F.coalesce(F.array_contains("_hit_lines", _digest(line)), F.lit(False)))
    text = F.when(F.col("_hit_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    if removed_col:
        count = F.when(F.col("_hit_lines").isNull(), 0).otherwise(F.size(_lines(F.col(text_col))) - F.size(kept))
        joined = joined.withColumns({removed_col: count.cast("long"), text_col: text})
    else:
        joined = joined.withColumn(text_col, text)
    return joined.drop("_hit_page", "_hit_host", "_hit_lines")
