"""Hard-negative mining by inner products with coordinate pruning in length buckets.

Rows are dealt to shards by label and length, anchors to blocks; a shard meets a
block in one task. There the rows are cut into buckets of falling length, each with
its directions' coordinates as sorted lists. For an anchor and the score still worth
finding, a bucket's longest row gives the cosine a row must reach at least; that
cosine bounds each coordinate of its direction. The rows inside the feasible ranges
of the anchor's few largest coordinates are the candidates, and their integer inner
products decide. The score worth finding rises with every hit.

Two passes: the first finds each anchor's positives among the rows of its label, the
second its negatives, whose scores lie in a range below each positive's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskrank.operators.joins import attach_dimension
from riskrank.session import materialise

SLACK = 1e-9  # what bounds in doubles are widened by; inner products themselves are exact
BANDS = 128  # lengths below 3e8 in steps of a quarter fall into fewer
MOST_SQUARED = 2.0**54  # squared lengths from here on are refused, so 100 scores stay in 64 bits

FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    least_percent: int = 80  # of the positive's score; the most is that score itself
    focus: int = 4
    shard_rows: int = 8192
    block_anchors: int = 16384
    bucket_rows: int = 1024


def _matrix(table: pa.Table, name: str, width: int = 0) -> np.ndarray:
    """Vectors as rows of equal length; shorter ones end in zeros."""
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = max(int(sizes.max(initial=0)), width)
    out = np.zeros((len(sizes), wide), np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


class Bucket:
    """Rows of similar length, with sorted lists of the coordinates of their directions."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray):
        self.vectors, self.ids, self.labels = vectors, ids, labels
        self.longest = float(norms[0])
        self.unit = vectors / np.maximum(norms, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        found = self._lists.get(coordinate)
        if found is None:
            values = self.unit[:, coordinate]
            order = np.argsort(values, kind="stable")
            found = self._lists[coordinate] = (order, values[order])
        return found

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that can have a cosine of at least ``cosine``; None for all of them."""
        if cosine <= 0:
            return None
        cosine = min(cosine, 1.0)
        inside = None
        for at in focus.tolist():
            q = min(1.0, max(-1.0, float(direction[at])))
            apart = math.sqrt((1 - q * q) * (1 - cosine * cosine))
            low = -1.0 if q <= -cosine else q * cosine - apart
            high = 1.0 if q >= cosine else q * cosine + apart
            order, values = self.sorted_list(at)
            a, b = np.searchsorted(values, [low - SLACK, high + SLACK])
            if b - a == len(order):
                continue
            if inside is None:
                inside = np.zeros(len(order), bool)
                inside[order[a:b]] = True
            else:
                here = np.zeros(len(order), bool)
                here[order[a:b]] = True
                inside &= here
            if not inside.any():
                break
        return None if inside is None else np.flatnonzero(inside)

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        return (self.vectors if rows is None else self.vectors[rows]) @ anchor


def buckets(table: pa.Table, width: int, rows: int) -> list[Bucket]:
    """The shard cut into buckets, the longest rows first; ties by id, so that a repeated task gives the same."""
    vectors = _matrix(table, "row_vector", width)
    ids, labels = (table.column(n).to_numpy() for n in ("row_id", "row_label"))
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norms))
    return [Bucket(vectors[part], ids[part], labels[part], norms[part])
            for part in np.split(order, range(rows, len(order), rows)) if len(part)]


class Best:
    """The first ``size`` of the rows seen: highest score, then smallest id."""

    def __init__(self, size: int):
        self.size = size
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int | None:
        """The score that a further row must reach; None while any will do."""
        return int(self.scores[-1]) if len(self.scores) == self.size else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.least is not None:
            worth = scores >= self.least
            scores, ids = scores[worth], ids[worth]
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > 4 * self.size:  # only what reaches the size-th best needs ordering
            reach = scores >= -np.partition(-scores, self.size - 1)[self.size - 1]
            scores, ids = scores[reach], ids[reach]
        order = np.lexsort((ids, -scores))[:self.size]
        self.scores, self.ids = scores[order], ids[order]


def _focus(direction: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(-np.abs(direction), kind="stable")[:count]


def _worth(cut: list[Bucket], anchor: np.ndarray, how: Mining, least) -> Iterator[tuple[Bucket, np.ndarray | None]]:
    """Buckets with their candidates, ``least()`` being the score worth finding by then (None: any)."""
    norm = math.sqrt(float((anchor.astype(np.float64) ** 2).sum()))
    direction = anchor / max(norm, 1e-300)
    focus = _focus(direction, how.focus)
    for bucket in cut:
        score, reach = least(), norm * bucket.longest
        if score is None or score <= 0:
            yield bucket, None
            continue
        if reach * (1 + SLACK) < score:
            return  # later buckets are shorter
        rows = bucket.candidates(direction, focus, score / reach * (1 - SLACK))
        if rows is None or len(rows):
            yield bucket, rows


def _prepared(block: pa.Table, shard: pa.Table, how: Mining) -> tuple[np.ndarray, list[Bucket]]:
    """The block's anchors and the shard's buckets, vectors of one length."""
    width = max(int(pc.max(pc.list_value_length(t.column(n))).as_py() or 0)
                for t, n in ((block, "vector"), (shard, "row_vector")))
    return _matrix(block, "vector", width), buckets(shard, width, how.bucket_rows)


def _part(values: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
    return values if rows is None else values[rows]


def positives(how: Mining):
    """Per anchor, the shard's best rows of the anchor's label."""
    def run(block: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if block.num_rows and shard.num_rows:
            anchors, cut = _prepared(block, shard, how)
            for anchor, own, label in zip(anchors, *(block.column(n).to_pylist() for n in ("anchor_id", "label"))):
                best = Best(how.positives)
                for bucket, rows in _worth(cut, anchor, how, lambda: best.least):
                    ids = _part(bucket.ids, rows)
                    fit = (_part(bucket.labels, rows) == label) & (ids != own)
                    best.add(bucket.scores(anchor, rows)[fit], ids[fit])
                out += [(own, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        anchor_id, positive_id, score = zip(*out) if out else ((), (), ())
        return pa.table({"anchor_id": pa.array(anchor_id, pa.int64()), "positive_id": pa.array(positive_id, pa.int64()),
                         "positive_score": pa.array(score, pa.int64())})

    return run


def negatives(how: Mining):
    """Per anchor and positive, the shard's best rows of other labels within the positive's range."""
    def run(block: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if block.num_rows and shard.num_rows:
            anchors, cut = _prepared(block, shard, how)
            columns = [block.column(n).to_pylist() for n in ("anchor_id", "label", "positives")]
            for anchor, own, label, pairs in zip(anchors, *columns):
                best = {p: Best(how.negatives) for p in {pair["score"] for pair in pairs}}
                floors = {p: -(-how.least_percent * p // 100) for p in best}

                def least() -> int:
                    return min(max(floors[p], floors[p] if b.least is None else b.least) for p, b in best.items())

                for bucket, rows in _worth(cut, anchor, how, least):
                    other = _part(bucket.labels, rows) != label
                    scores, ids = bucket.scores(anchor, rows)[other], _part(bucket.ids, rows)[other]
                    for p, found in best.items():
                        fit = (100 * scores >= how.least_percent * p) & (scores <= p)
                        found.add(scores[fit], ids[fit])
                out += [(own, pair["id"], pair["score"], i, s) for pair in pairs
                        for i, s in zip(best[pair["score"]].ids.tolist(), best[pair["score"]].scores.tolist())]
        names = [part.split()[0] for part in FOUND.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names)

    return run


def usable_rows(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector, norm): rows that take part, components as floor(256 * x)."""
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = df.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("vector"))
    squared = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    sized = whole.withColumn("norm", F.sqrt(squared)).where(F.col("norm") * F.col("norm") < MOST_SQUARED)
    one = F.min(F.struct("label", "vector", "norm")).alias("one")
    return sized.groupBy("vec_id").agg(one).select("vec_id", "one.*")


def mine(df: DataFrame, anchor_every: int = 100, how: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by ``anchor_every``. Rows with a null
    id or label, a null vector, or any null or non-finite component take no part, nor
    do vectors of a length from 2^27 on (after the factor 256), whose scores would
    leave 64 bits. Of rows that share an id, the one of least label, then vector, takes
    part. Of vectors of unequal length the shorter one ends in zeros; a positive with a
    score below 0 has no negatives. Empty tables give no rows.
    """
    rows = materialise(usable_rows(df), "vectors")
    count = rows.count()
    packs = max(1, math.ceil(count / how.shard_rows))
    pack = F.pmod(F.xxhash64("label"), F.lit(packs)).cast("int")
    band = F.when(F.col("norm") > 0, 1 + F.floor(F.log("norm") / math.log(1.25))).otherwise(0).cast("int")
    dealt = rows.withColumn("cell", pack * BANDS + band)
    sizes = dealt.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / how.shard_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    placed = materialise(attach_dimension(dealt, sizes, "cell").withColumn("chunk", chunk).drop("chunks"), "placed")
    shards = materialise(placed.groupBy("cell", "chunk").agg(F.max("norm").alias("longest")).withColumn(
        "pack", F.floor(F.col("cell") / BANDS).cast("int")), "shards")

    anchors = placed.where(F.col("vec_id") % anchor_every == 0).select(
        F.col("vec_id").alias("anchor_id"), "label", "vector", "norm", pack.alias("pack"))
    blocks = max(1, math.ceil(anchors.count() / how.block_anchors))
    block = F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(blocks)).cast("int")
    anchors = anchors.withColumn("block", block)
    # A shard goes to every block of anchors, a block to every shard that can matter to it.
    key = ["block", "cell", "chunk"]
    every_block = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        *key, F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"), F.col("vector").alias("row_vector"))

    same = anchors.join(shards, "pack").select(*key, "anchor_id", "label", "vector")
    near = same.groupBy(*key).cogroup(every_block.groupBy(*key)).applyInArrow(
        positives(how), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = materialise(near.withColumn("place", place).where(F.col("place") <= how.positives).where(
        "positive_score >= 0"), "positives")
    known = chosen.groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))
        .alias("positives"), F.min("positive_score").alias("lowest"))

    far = anchors.drop("pack").join(known, "anchor_id").withColumn(
        "pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(shards, "pack").where(
        F.col("norm") * F.col("longest") * (1 + SLACK) >= F.col("lowest") * (how.least_percent / 100))
    found = far.select(*key, "anchor_id", "label", "vector", "positives").groupBy(*key).cogroup(
        every_block.groupBy(*key)).applyInArrow(negatives(how), FOUND)
    rank = F.row_number().over(
        Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= how.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
