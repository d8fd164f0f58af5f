"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to a few owners, the rarest to the first. Items
travel in bundles: a bundle enters each owner's stage with its terms and its
accumulators (item, document, score so far), meets there that owner's postings in
a cogroup, adds their integer contributions, and goes on to the next owner. A
bundle travels once per shard of the documents, which bounds what one group holds
whatever a term's frequency is.

Between stages an accumulator goes when even the most that later owners can add
leaves it below its item's tenth best so far: that loses nothing, since scores only
grow. The last stage returns each shard's best documents, and a ranking over the
shards picks the final ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskrank.llm.common import texts
from riskrank.operators.joins import attach_dimension
from riskrank.session import materialise

# Every ASCII character that is neither letter nor digit separates terms; A-Z are lower-cased, all else stays.
_TERMS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
               for b in range(256))
_ROWS_A_BATCH = 200_000
_LENGTH = -1  # term number of the row that holds a document's length
_SUM = -1  # owner of rows that are accumulators, not terms of an item

CARRIED = "bundle int, shard int, owner int, item_id long, key long, value long, bound long"


@dataclass(frozen=True)
class Search:
    best: int = 10
    owners: int = 4
    bundle_items: int = 256
    shard_documents: int = 4096
    broadcast_terms: int = 200_000  # up to so many terms (and 8 MB) the items' vocabulary is broadcast


def count_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf): one row per distinct term of each text, and one with the empty term and the text's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, counts = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").cast(pa.binary()).to_pylist()):
                found = Counter(text.translate(_TERMS).split())
                if not found:
                    continue
                ids += [doc_id] * (len(found) + 1)
                terms.append(b"")
                terms += found
                counts.append(found.total())
                counts += found.values()
                if len(ids) >= _ROWS_A_BATCH:
                    yield _counted(ids, terms, counts)
                    ids, terms, counts = [], [], []
        if ids:
            yield _counted(ids, terms, counts)

    held = texts(df, id_col, text_col).where(F.col("doc_id").isNotNull())
    return held.mapInArrow(run, "doc_id long, term string, tf long")


def _counted(ids: list, terms: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
        ["doc_id", "term", "tf"])


def stage(owner: int, last: bool, how: Search):
    """What the owner of some terms does with a bundle: adds its contributions and drops what cannot be among the best."""
    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        column = {name: bundle.column(name).to_numpy() for name in bundle.column_names}
        if not len(column["owner"]):
            return bundle
        terms, docs, parts = (postings.column(n).to_numpy() for n in ("term_id", "doc_id", "part"))
        sums, mine, later = column["owner"] == _SUM, column["owner"] == owner, column["owner"] > owner
        items, item_at = np.unique(column["item_id"], return_inverse=True)
        doc_ids, doc_at = np.unique(np.concatenate([docs, column["key"][sums]]), return_inverse=True)
        scores = np.zeros((len(items), len(doc_ids)), np.int64)
        scores[item_at[sums], doc_at[len(docs):]] = column["value"][sums]

        order = np.argsort(terms, kind="stable")
        terms, docs, parts = terms[order], doc_at[:len(docs)][order], parts[order].astype(np.int64)
        asked = column["key"][mine]
        begins, ends = np.searchsorted(terms, asked), np.searchsorted(terms, asked, "right")
        for item, weight, a, b in zip(item_at[mine].tolist(), column["value"][mine].tolist(),
                                      begins.tolist(), ends.tolist()):
            if b > a:
                scores[item, docs[a:b]] += weight * parts[a:b]

        to_come = np.zeros(len(items), np.int64)
        np.add.at(to_come, item_at[later], column["bound"][later])
        kept_items, kept_docs, kept_scores = [], [], []
        for item, row in enumerate(scores):
            least = np.partition(row, -how.best)[-how.best] if len(row) > how.best else 0
            at = np.flatnonzero((row > 0) & (row + to_come[item] >= least))
            if last and len(at) > how.best:
                at = at[np.lexsort((doc_ids[at], -row[at]))[:how.best]]
            kept_items.append(np.full(len(at), items[item]))
            kept_docs.append(doc_ids[at])
            kept_scores.append(row[at])
        n = sum(map(len, kept_docs))
        passed = {name: values[later] for name, values in column.items()}
        made = {"bundle": np.full(n, column["bundle"][0]), "shard": np.full(n, column["shard"][0]),
                "owner": np.full(n, _SUM), "item_id": np.concatenate(kept_items),
                "key": np.concatenate(kept_docs), "value": np.concatenate(kept_scores), "bound": np.zeros(n, np.int64)}
        return pa.table([pa.array(np.concatenate([passed[f.name], made[f.name]]).astype(f.type.to_pandas_dtype()))
                         for f in bundle.schema], bundle.schema.names)

    return run


def search(docs: DataFrame, items: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, equal scores by document id.

    Rows that share an id are one document (or item), their terms counted together.
    Rows with a null id take no part; null and empty texts have no terms. Items that
    no document scores above 0 for, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    asked = materialise(
        count_terms(items, item_col, item_text_col).where("term <> ''")
        .groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("times")), "item_terms")
    vocabulary = materialise(
        asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
        .union(spark.createDataFrame([("", _LENGTH)], "term string, term_id long")), "terms")

    counted = count_terms(docs, id_col, text_col)
    found = attach_dimension(counted, vocabulary, "term", max_rows=how.broadcast_terms) \
        .where(F.col("term_id").isNotNull()).select("doc_id", "term_id", "tf")
    # One exchange by document: the sums and the length beside each of them need no other.
    summed = found.repartition("doc_id").groupBy("doc_id", "term_id").agg(F.sum("tf").alias("tf"))
    length = F.max(F.when(F.col("term_id") == _LENGTH, F.col("tf"))).over(Window.partitionBy("doc_id"))
    postings = materialise(summed.withColumn("n", length), "postings")

    total = postings.where(F.col("term_id") == _LENGTH).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    postings = postings.where(F.col("term_id") != _LENGTH)

    # Weights, and the most a term can add: its largest frequency in the shortest document there could be.
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weighted = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most")).select(
        "term_id", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"),
        F.expr("(1000000000 * most) div (1000 * most + 8 * 25)").alias("most_part"))
    bundles = -(-asked.select("item_id").distinct().count() // how.bundle_items)
    wanted = materialise(
        asked.join(vocabulary, "term").join(weighted.where("weight > 0"), "term_id").select(
            F.pmod(F.xxhash64("item_id"), F.lit(max(1, bundles))).cast("int").alias("bundle"), "item_id", "term_id",
            "weight", (F.col("weight") * F.col("times")).alias("value"),
            (F.col("weight") * F.col("times") * F.col("most_part")).alias("bound")), "wanted")
    steps = [i / how.owners for i in range(how.owners - 1, 0, -1)]
    cuts = (wanted.agg(F.percentile_approx("weight", F.array(*map(F.lit, steps)))).first()[0] or []) if steps else []
    owner = sum((F.when(F.col("weight") < cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    wanted = wanted.withColumn("owner", owner)
    owned = wanted.select("bundle", "term_id", "owner").distinct()

    shards = max(1, -(-n_docs // how.shard_documents))
    part = F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (25 + ((75 * n * {n_docs}L) div {n_terms}L)))")
    dealt = _per_bundle(postings.select(
        "term_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id",
        part.cast("int").alias("part")), owned, how)

    carried = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        "bundle", "shard", "owner", "item_id", F.col("term_id").alias("key"), "value", "bound")
    for step in range(how.owners):
        own = dealt.where(F.col("owner") == step).select("bundle", "shard", "term_id", "doc_id", "part")
        carried = carried.groupBy("bundle", "shard").cogroup(own.groupBy("bundle", "shard")).applyInArrow(
            stage(step, step == how.owners - 1, how), CARRIED)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("value"), "key"))
    return carried.withColumn("rank", place).where(F.col("rank") <= how.best).select(
        "item_id", "rank", F.col("key").alias("doc_id"), F.col("value").alias("score"))


def _per_bundle(postings: DataFrame, owned: DataFrame, how: Search) -> DataFrame:
    """Postings once per bundle that asks for their term, with the term's owner.

    Up to the stated number of rows the terms are broadcast; beyond it a frequent
    term's rows are split by the skew rule of the adaptive planner.
    """
    held = materialise(owned, "owned")
    small = held.limit(how.broadcast_terms + 1).count() <= how.broadcast_terms
    return postings.join(F.broadcast(held) if small else held, "term_id")
