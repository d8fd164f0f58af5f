"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``bands * rows`` coordinates. In each of the first rounds every
shingle of a document is hashed to a bin and leaves a value there; a bin keeps
the least value of the earliest round that reached it. After as many rounds as
there are bins, round ``size + i`` throws all shingles into bin ``i``, so every
coordinate fills, however small the document. Two sets agree in a coordinate
with the probability of their Jaccard similarity, and the sums concentrate as
for independent minima, at a cost of about ``size * log(size) + shingles``
hashes a document instead of ``size * shingles``.

Documents with the same set form a class and are sketched once. Classes that
share a band are compared with the band bucket's smallest class, on the full
sets; where that leaves a bucket in several components, with its most central
class too. Members that both stars leave in different components are then
compared with each other, except where the distances to the first centre prove
by the triangle inequality that they cannot be linked, or where one-bit codes of
a sketch of 2,048 coordinates differ more than those of linked sets do but with
a probability of about 1e-7, the order of what the bands miss. Components are
thus those of all pairs that share a band; pairs inside a component are not
enumerated.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.llm.common import by_batch, forget_others, lists, mix, texts, utf8
from riskrank.llm.components import components
from riskrank.session import materialise, release

WORD_CACHE = 1 << 17
CHUNK_SHINGLES = 1 << 18
HELD_ROWS = 1_000  # texts that a worker holds as Python objects at once
CODE_BITS = 2048
CODE_CHUNK = 256
MOST_BITS = 27  # the filter of ids takes 2 ** 27 bits, 16 MB, at most


@dataclass(frozen=True)
class NearDup:
    """words: shingle length. percent: least 100 * intersection / union of a link.

    A pair at 0.8 shares none of 40 bands of 5 with probability 1.3e-7.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5


class _Words(dict):
    """64-bit hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of the whole sequence if it is shorter."""
    found = text.lower().split()  # of bytes: ASCII letters, and exactly the separators \\x20 \\x09-\\x0D
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for at in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + len(total)])
    return np.unique(total)


def fast_sketch(values: np.ndarray, owner: np.ndarray, documents: int, size: int) -> np.ndarray:
    """Sketches, (documents, size), of the sets that ``owner`` deals ``values`` to; no set may be empty."""
    sketch = np.full(documents * size, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(documents * size, bool)
    owner = owner.astype(np.int64)
    for turn in range(2 * size):
        mixed = mix(values ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (mixed >> np.uint64(32)).astype(np.int64) % size if turn < size else turn - size
        cell = owner * size + bins
        free = ~filled[cell]
        np.minimum.at(sketch, cell[free], mixed[free])
        filled[cell] = True
        lacking = ~filled.reshape(documents, size).all(axis=1)
        if not lacking.any():
            break
        keep = lacking[owner]
        values, owner = values[keep], owner[keep]
    return sketch.reshape(documents, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for at in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, at])
    return keys.view(np.int64)


def _sketch_batch(batch: pa.RecordBatch, how: NearDup, known: _Words) -> dict:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    keep_null = batch.column("doc_id")
    sizes = np.zeros(len(ids), np.int64)
    prints = np.zeros((len(ids), 2), np.uint64)
    keys = np.zeros((len(ids), how.bands), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    weight = 0

    def flush():
        nonlocal held, weight
        if held:
            rows = np.array([r for r, _ in held])
            counts = np.array([len(s) for _, s in held])
            values = np.concatenate([s for _, s in held])
            owner = np.repeat(np.arange(len(held)), counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            prints[rows, 0] = np.add.reduceat(mix(values), starts)
            prints[rows, 1] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            keys[rows] = band_keys(fast_sketch(values, owner, len(held), how.bands * how.rows),
                                   how.bands, how.rows)
            sizes[rows] = counts
        held, weight = [], 0

    for row, text in enumerate(utf8(batch)):
        found = shingles(text, how.words, known)
        if len(found):
            held.append((row, found))
            weight += len(found)
            if weight >= CHUNK_SHINGLES or len(held) >= 2048:
                flush()
    flush()
    return {"doc_id": keep_null, "n_shingles": sizes, "print_a": prints[:, 0].copy().view(np.int64),
            "print_b": prints[:, 1].copy().view(np.int64), "keys": lists(keys.ravel(), how.bands, pa.int64())}


def sketches(docs: DataFrame, how: NearDup) -> DataFrame:
    known = _Words()
    return by_batch(docs, lambda b: _sketch_batch(b, how, known),
                    "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>", HELD_ROWS)


def _members_only(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``needed`` (doc_id, distinct), without shuffling the other texts.

    The ids set bits of a filter of bounded size, which is broadcast; what it lets through
    is settled by an exact join. Beyond the bound the filter lets more through, no less.
    """
    bits = 1 << min(MOST_BITS, max(15, math.ceil(math.log2(16 * needed.count() + 1))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    filled = needed.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passed = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(filled), "_bucket") \
        .where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits")
    return passed.join(needed, "doc_id", "left_semi")


def _shingle_sets(pairs: DataFrame, docs: DataFrame, how: NearDup) -> DataFrame:
    """(id, grams): the full shingle sets of the documents in ``pairs``."""
    needed = materialise(pairs.select(F.col("a").alias("doc_id")).union(
        pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")
    known = _Words()

    def build(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("doc_id"),
                "grams": pa.array([shingles(t, how.words, known).tobytes() for t in utf8(batch)], pa.binary())}

    sets = materialise(by_batch(_members_only(docs, needed), build, "id long, grams binary", HELD_ROWS), "sets")
    release(needed)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total) of pairs, from the full sets of both."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            shared, total = [], []
            for one, two in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
                ["a", "b", "shared", "total"])

    return (pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "grams_a", "grams_b")
            .mapInArrow(compare, "a long, b long, shared long, total long"))


def _unsettled(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, away, component) of the buckets whose members are in several components."""
    placed = materialise(placed.join(found.withColumnRenamed("node", "rep"), "rep", "left")
                         .select("key", "rep", "away", F.coalesce("component", "rep").alias("component")),
                         "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low < high").select("key")
    open_ = materialise(placed.join(several, "key", "left_semi"), "open")
    release(placed)
    return open_


def _second_stars(open_: DataFrame) -> DataFrame:
    """Pairs of each bucket's most central member, the one that shares most buckets with others, and the rest.

    The original that edited copies were made from shares more bands with them
    than they share with each other, so it links what the first star left apart.
    """
    crowd = (open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "key")
             .groupBy("rep").agg(F.sum("members").alias("crowd")))
    centres = (open_.join(crowd, "rep").groupBy("key")
               .agg(F.max(F.struct("crowd", -F.col("rep"), "component")).alias("top"))
               .select("key", (-F.col("top.col2")).alias("hub"), F.col("top.component").alias("hub_component")))
    return (open_.join(centres, "key").where(F.col("component") != F.col("hub_component"))
            .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())


def most_differing(how: NearDup) -> int:
    """Bits of two codes that differ at most, for linked sets but with a probability of about 1e-7."""
    least = how.percent / 100
    return math.ceil(CODE_BITS * (1 - least) / 2 + 5.5 * math.sqrt(CODE_BITS * (1 - least * least) / 4))


def codes(sets: DataFrame) -> DataFrame:
    """(rep, code): the lowest bit of each coordinate of a long sketch, 64 to a number.

    Bits of equal coordinates agree, others by chance in every second case.
    """
    def build(batch: pa.RecordBatch) -> dict:
        grams = [np.frombuffer(g.as_py(), np.uint64) for g in batch.column("grams")]
        made = []
        for at in range(0, len(grams), CODE_CHUNK):
            part = grams[at:at + CODE_CHUNK]
            owner = np.repeat(np.arange(len(part)), [len(g) for g in part])
            bits = fast_sketch(np.concatenate(part), owner, len(part), CODE_BITS) & np.uint64(1)
            made.append(np.packbits(bits.astype(np.uint8), axis=1).view(np.int64))
        return {"rep": batch.column("id"), "code": lists(np.concatenate(made).ravel(), CODE_BITS // 64, pa.int64())}

    return by_batch(sets, build, "rep long, code array<long>")


def _across(still: DataFrame, sets: DataFrame, classes: DataFrame, how: NearDup) -> DataFrame:
    """Pairs of unsettled buckets that may be linked, from different components.

    Left out is what the distances to the first centre rule out by the triangle
    inequality, what the sizes rule out, and pairs whose long codes differ more
    than those of linked sets do. Each pair comes from the first band it shares.
    """
    reps = still.select("rep").distinct()
    short = lambda key: key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    bands = (classes.join(reps, "rep", "left_semi")
             .select("rep", "n_shingles", F.transform("keys", short).alias("bands")))
    code = codes(sets.join(reps.withColumnRenamed("rep", "id"), "id", "left_semi"))
    known = materialise(bands.join(code, "rep"), "codes")
    full = still.join(known, "rep").withColumn("at", F.array_position("bands", short(F.col("key")))).where("at > 0")
    x, y = full.alias("x"), full.alias("y")
    reach = 1 - how.percent / 100 + 1e-9
    differing = functools.reduce(operator.add, (
        F.bit_count(F.col("x.code")[i].bitwiseXOR(F.col("y.code")[i])) for i in range(CODE_BITS // 64)))
    before = F.col("x.at") - 1
    apart = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
        & (F.col("x.away") > 0) & (F.col("y.away") > 0)  # the centre itself was compared with all
        & (F.abs(F.col("x.away") - F.col("y.away")) <= reach)
        & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * how.percent)
        & (differing <= most_differing(how))
        & ~F.arrays_overlap(F.slice("x.bands", F.lit(1), before), F.slice("y.bands", F.lit(1), before)))
    return x.join(y, apart).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def link_documents(df: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Texts without words and null texts have no shingles and link with nothing.
    Rows that repeat an id count as one document whose texts' links are pooled.
    A row with a null id gets the component of the documents with its set; with
    none, its component is null and it is not kept. An empty table gives no rows.
    """
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = materialise(sketches(docs, how), "sketches")
    prints = ["print_a", "print_b", "n_shingles"]
    classes = materialise(sketched.where("n_shingles > 0").groupBy(*prints).agg(
        F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    sized = materialise(sketched.select("doc_id", *prints), "sizes")
    heads = materialise(classes.drop("keys"), "heads")
    release(sketched)
    members = classes.where("rep is not null").select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("members")) \
        .where("members > 1").select("key", "centre")
    shared = materialise(members.join(buckets, "key"), "buckets")

    stars = shared.where("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    stars = materialise(stars, "pairs")
    sets = _shingle_sets(stars, docs, how)  # every member of a shared bucket is in one of these pairs
    compared = materialise(_verified(stars, sets), "stars")
    linked = F.col("shared") * 100 >= F.col("total") * how.percent
    first = components(compared.where(linked))

    # Buckets whose members are still in several components: one more star, around the member in the densest buckets.
    distance = 1 - F.col("shared") / F.col("total")
    placed = shared.join(compared.select(F.col("a").alias("rep"), F.col("b").alias("centre"), distance.alias("away")),
                         ["rep", "centre"], "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
    open_ = _unsettled(placed, first)
    release(shared, stars)
    found = first
    if open_.isEmpty():
        release(sets, compared, open_)
    else:
        members = open_.select(F.col("rep").alias("id")).distinct()
        fewer = materialise(sets.join(members, "id", "left_semi"), "sets")
        again = materialise(_second_stars(open_), "pairs")
        second_stars = materialise(_verified(again, fewer), "stars")
        release(sets, again)
        links = compared.where(linked).select("a", "b").union(second_stars.where(linked).select("a", "b"))
        still = _unsettled(open_.drop("component"), components(links))
        release(open_)
        rest = materialise(_across(still, fewer, classes, how), "rest")
        found = components(links.union(_verified(rest, fewer).where(linked).select("a", "b")))
        release(compared, fewer, second_stars, still, rest)
    release(classes)
    labels = heads.join(found.withColumnRenamed("node", "rep"), "rep", "left") \
        .select(*prints, F.coalesce("component", "rep").alias("component"))
    return (sized.join(labels, prints, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def keep_one(df: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the smallest id of its component; rows with a null id stay."""
    gone = link_documents(df, how, id_col, text_col).where("not kept and doc_id is not null") \
        .select(F.col("doc_id").alias("_gone_id")).distinct()
    return df.join(gone, F.col(id_col) == F.col("_gone_id"), "left_anti")
