"""Ranked search and hard-negative mining against brute force and on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from compare import connect, difference
from riskrank.llm import hard_negatives, lexical, queries
from riskrank.llm.hard_negatives import Mining
from riskrank.llm.lexical import Search

FOLDER = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")


# Search ------------------------------------------------------------------

def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(docs, items, best=10):
    texts, asked = defaultdict(Counter), defaultdict(Counter)
    for target, rows in ((texts, docs), (asked, items)):
        for key, text in rows:
            if key is not None:
                target[key].update(terms(text))
    texts = {k: c for k, c in texts.items() if c}
    n_docs, total = len(texts), sum(c.total() for c in texts.values())
    df = Counter(t for c in texts.values() for t in c)
    out = set()
    for item, wanted in asked.items():
        scores = []
        for doc, c in texts.items():
            m = 25 + (75 * c.total() * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if c[t])
            if score > 0:
                scores.append((-score, doc))
        out |= {(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:best], 1)}
    return out


def found(spark, docs, items, **how):
    made = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string"), Search(**how))
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("owners, shard, bundle", [(1, 10_000, 256), (4, 50, 3)])
def test_search_against_all_documents(spark, owners, shard, bundle):
    chance = random.Random(owners)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "ÉTÉ", "été", "é", "a1", "中文"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(most):
        return chance.choice([" ", ", ", "\n", "-"]).join(chance.choices(words, weights, k=chance.randint(0, most)))

    docs = [(i, text(40)) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # many equal scores
    docs += [(3, "the w1 w1"), (None, "w5 w5"), (2000, None), (2001, ""), (2002, "--- !!"), (2003, "w1 " * 20_000)]
    items = [(i, text(15)) for i in range(20)] + [(5, "w3 w3 W3"), (None, "w1"), (50, None), (51, "nowhere")]
    assert found(spark, docs, items, owners=owners, shard_documents=shard, bundle_items=bundle) == ranked(docs, items)


def test_search_without_the_broadcast_of_terms(spark):
    chance = random.Random(5)
    docs = [(i, " ".join(["hot"] + chance.choices("abcdefgh", k=6))) for i in range(300)]
    items = [(i, " ".join(chance.choices(["hot", "a", "b", "c", "x"], k=4))) for i in range(8)]
    assert found(spark, docs, items, broadcast_terms=1, shard_documents=64) == ranked(docs, items)


def test_search_on_empty_tables_and_clashing_columns(spark):
    docs, items = [(1, "a b"), (2, "a c"), (3, "d")], [(1, "b c"), (2, "z")]
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == set()
    wide = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id int, text string, term string, tf int, n int")
    asked = spark.createDataFrame([(*i, "y", 0) for i in items], "item_id int, text string, rank string, doc_id int")
    made = lexical.search(wide, asked)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in made.collect()} == ranked(docs, items)


def test_stage_drops_only_what_cannot_come_back():
    """An accumulator stays exactly when its score and what is to come reach the best so far."""
    import pyarrow as pa

    names = [p.split()[0] for p in lexical.CARRIED.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64()] * 4
    rows = [(0, 0, 0, 1, 10, 5, 50), (0, 0, 1, 1, 11, 4, 12)]
    bundle = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    postings = pa.table({"term_id": pa.array([10] * 4, pa.int64()), "doc_id": pa.array([1, 2, 3, 4], pa.int64()),
                         "part": pa.array([10, 9, 8, 7], pa.int32())})
    out = lexical.stage(0, False, Search(best=1))(bundle, postings).to_pylist()
    assert {(r["key"], r["value"]) for r in out if r["owner"] == -1} == {(1, 50), (2, 45), (3, 40)}
    assert [r["key"] for r in out if r["owner"] == 1] == [11]


# Mining ------------------------------------------------------------------

def mined(rows, every, positives=5, negatives=5, least=80):
    fine = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None \
                or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if vec_id not in fine or (label, whole) < fine[vec_id]:
            fine[vec_id] = (label, whole)
    out = set()
    for anchor, (label, vector) in fine.items():
        if anchor % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, other)), i, kind == label)
                        for i, (kind, other) in fine.items() if i != anchor)
        for p, positive, _ in [s for s in scores if s[2]][:positives]:
            fit = [(s, i) for s, i, same in scores if not same and least * -p <= 100 * -s <= 100 * -p]
            out |= {(anchor, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(fit[:negatives], 1)}
    return out


def negatives_of(spark, rows, every=10, label="int", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {label}")
    out = [tuple(r) for r in hard_negatives.mine(df, every, Mining(**how)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def vectors(seed, count, labels, spread, width=12):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(labels, width))
    rows = []
    for i in range(count):
        label = int(chance.integers(labels)) if chance.random() > 0.3 else 0
        v = centres[(label + int(chance.random() < 0.4)) % labels] + spread * chance.normal(size=width)
        rows.append((i, [float(x) for x in v.astype(np.float32) * np.float32(2.0 ** chance.integers(-4, 5))], label))
    return rows


@pytest.mark.parametrize("how", [
    {}, {"shard_rows": 40, "block_anchors": 7, "bucket_rows": 16}, {"shard_rows": 64, "bucket_rows": 8, "focus": 2}])
def test_mining_against_all_pairs(spark, how):
    for seed, labels, spread in ((1, 4, 0.05), (2, 40, 0.5))[1 if how else 0:]:
        rows = vectors(seed, 600, labels, spread)
        want = mined(rows, 10)
        assert want and negatives_of(spark, rows, **how) == want


def test_mining_ties_repeats_and_awkward_rows(spark):
    rows = vectors(3, 80, 3, 0.2, width=4)
    rows += [(i, rows[i % 9][1], rows[i % 9][2]) for i in range(100, 190)]  # equal vectors: ties by id
    rows += [(i, [0.0] * 4, i % 2) for i in range(200, 212)]  # score 0 with all
    rows += [(300, None, 1), (310, [1.0, None, 1.0, 1.0], 1), (320, [NAN] * 4, 1), (330, [INF] * 4, 1),
             (340, [1.0] * 4, None), (None, [1.0] * 4, 1), (350, [], 1), (360, [1.0], 2), (370, [1.0] * 6, 2),
             (7, [9.0] * 4, 2), (7, [1.0] * 4, 0), (20, rows[20][1], rows[20][2]), (-10, [0.5, 0.1, -0.3, 0.2], 1)]
    want = mined(rows, 10)
    assert negatives_of(spark, rows) == want
    assert negatives_of(spark, rows, shard_rows=16, block_anchors=5, bucket_rows=4) == want
    assert negatives_of(spark, []) == set()
    assert negatives_of(spark, [(10, [1.0], 1)]) == set()


def test_mining_with_clashing_columns(spark):
    rows = vectors(4, 100, 3, 0.2)
    df = spark.createDataFrame([(*r, 1.0, 2, "x", "y") for r in rows],
                               "vec_id long, embedding array<double>, label long, norm double, cell int, "
                               "block string, anchor_id string")
    assert {tuple(r) for r in hard_negatives.mine(df, 10).collect()} == mined(rows, 10)


def test_candidates_hold_every_row_that_reaches_the_cosine():
    chance = np.random.default_rng(6)
    rows = chance.normal(size=(300, 6)) * np.linspace(3, 1, 300)[:, None]
    whole = np.floor(256 * rows).astype(np.int64)
    norms = np.sqrt((whole ** 2).sum(axis=1))
    order = np.argsort(-norms)
    bucket = hard_negatives.Bucket(whole[order], order, order, norms[order])
    pruned = 0
    for _ in range(200):
        anchor = chance.normal(size=6)
        anchor /= np.linalg.norm(anchor)
        cosine = chance.uniform(0.3, 0.999)
        reach = np.flatnonzero(bucket.unit @ anchor >= cosine)
        got = bucket.candidates(anchor, hard_negatives._focus(anchor, 4), cosine)
        assert got is None or set(reach) <= set(got)
        pruned += 300 - (300 if got is None else len(got))
    assert pruned > 200 * 150


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_lexical_search"])
def test_queries_equal_their_twins(spark, name):
    got = queries.REGISTRY[name](spark, FOLDER).toPandas()
    assert len(got) and difference(got, connect(FOLDER).execute(oracle_sql()[name]).df()) is None


def test_search_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(
        f"{folder}/{name}.parquet").select(F.col(key), "text").collect()]
    got = {tuple(r) for r in queries.op13_lexical_search(spark, folder).collect()}
    assert got == ranked(read("documents", "doc_id"), read("benchmark", "item_id"))
