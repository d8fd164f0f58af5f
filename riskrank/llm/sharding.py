"""Shards as runs of a Hilbert curve over document metadata, in column functions only.

Source, language and size are quantised to a grid; documents are ordered by the
curve index of their cell and cut into runs whose row counts differ by one at
most (law ``rows``). Documents near on the curve share most of their metadata,
so a reader that filters on any of the three can skip most shards.

The order inside a cell is by a hash of the id. Ranks come from counts: cells
are divided into slices of about ``slice_rows`` documents by that hash, slices
are numbered within themselves, and the running total over the slice counts
(one row per slice) gives each its first rank. A cell with a third of all rows
is just many slices.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskrank.session import materialise


@dataclass(frozen=True)
class Sharding:
    shards: int = 24
    bits: int = 4  # per dimension, so the grid has 2 ** (3 * bits) cells
    slice_rows: int = 1_000_000


def _slot(value: Column, bits: int) -> Column:
    """A string's place on an axis: equal strings together."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def _magnitude(size: Column, bits: int) -> Column:
    """Two steps to each doubling from 64 bytes on."""
    step = F.floor(2 * F.log2(size.cast("double"))) - 12
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits per axis.

    The state is the axes' array. For each bit from the top, an axis that has the
    bit set inverts the lower bits of the first axis, and one that has not swaps
    its lower bits with the first axis'; a Gray decoding follows, and the axes'
    bits are interleaved.
    """
    n = len(axes)

    def stepped(point: Column, low: Column, bit: Column, i: int) -> Column:
        swap = F.get(point, F.lit(0)).bitwiseXOR(F.get(point, F.lit(i))).bitwiseAND(low)
        bit_set = F.call_function("shiftright", F.get(point, F.lit(i)), bit).bitwiseAND(F.lit(1)) == 1

        def moved(k: Column) -> Column:
            value = F.get(point, k)
            inverted = F.when(k == 0, value.bitwiseXOR(low)).otherwise(value)
            swapped = F.when((k == 0) | (k == i), value.bitwiseXOR(swap)).otherwise(value)
            return F.when(bit_set, inverted).otherwise(swapped)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), moved)

    def once(point: Column, use) -> Column:
        """``use`` of a point as a variable: as the only element of an array it is computed once."""
        return F.get(F.transform(F.array(point), lambda p: use(p)), F.lit(0))

    def turn(point: Column, bit: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1), bit) - 1
        for i in range(n):
            point = once(point, partial(stepped, low=low, bit=bit, i=i))
        return point

    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), F.array(*axes), turn) \
        if bits > 1 else F.array(*axes)

    def decoded(point: Column) -> Column:
        gray = [F.get(point, F.lit(0))]
        for i in range(1, n):
            gray.append(F.get(point, F.lit(i)).bitwiseXOR(gray[-1]))
        flip = F.lit(0)
        for q in range(bits - 1, 0, -1):
            set_ = F.call_function("shiftright", gray[-1], F.lit(q)).bitwiseAND(F.lit(1)) == 1
            flip = flip.bitwiseXOR(F.when(set_, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
        index = F.lit(0).cast("long")
        for q in range(bits - 1, -1, -1):
            for g in gray:
                digit = F.call_function("shiftright", g.bitwiseXOR(flip), F.lit(q)).bitwiseAND(F.lit(1))
                index = index * 2 + digit
        return index

    return once(turned, decoded)


def shard_documents(df: DataFrame, how: Sharding = Sharding(), id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row.

    size is the text's UTF-8 length plus 8. Null texts count as empty, null
    languages and sources as one value each. Rows that repeat an id get places of
    their own; which of them is first is left open where all else is equal.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        _slot(F.col(source_col), how.bits).alias("x"), _slot(F.col(lang_col), how.bits).alias("y"))
    rows = materialise(rows.withColumn("z", _magnitude(F.col("size"), how.bits)), "sized")

    # At most 2 ** (3 * bits) rows: both broadcasts below are bounded by that and by rows / slice_rows.
    cells = rows.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("cell_rows")).select(
        "x", "y", "z", hilbert_index([F.col("x"), F.col("y"), F.col("z")], how.bits).alias("curve"),
        F.ceil(F.col("cell_rows") / how.slice_rows).cast("int").alias("slices"))
    cells = materialise(cells, "cells")
    placed = rows.join(F.broadcast(cells), ["x", "y", "z"]).withColumns({
        "mark": F.xxhash64("doc_id", F.lit(how.shards))}) \
        .withColumn("slice", F.pmod("mark", F.col("slices")).cast("int"))
    counts = placed.groupBy("curve", "slice").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("curve", "slice")
    firsts = materialise(counts.withColumns({
        "first": F.sum("n").over(running) - F.col("n"),
        "total": F.sum("n").over(Window.partitionBy())}), "slices").drop("n")
    within = Window.partitionBy("curve", "slice").orderBy("mark", "doc_id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(
        F.broadcast(firsts), ["curve", "slice"]) \
        .withColumn("place", F.col("first") + F.col("rank") - 1)
    # Whole-number cut: shard s starts at ceil(s * total / shards).
    shard = F.expr(f"(place * {how.shards}) div total")
    start = F.expr(f"(shard * total + {how.shards - 1}) div {how.shards}")
    return (ranked.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
                    F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "curve"))
