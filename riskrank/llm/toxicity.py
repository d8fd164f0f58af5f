"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is the logistic of the summed weights of its traits
(words and pieces of words); a document's is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted on document labels alone, by the gradient
of the document likelihood, which puts the blame on the sentences that the model
finds most likely. The sentences that carry a verdict can then be located.

Traits are chosen first, by how much more often than chance they occur in toxic
documents; near copies in the sample count once there, so that a copied document
does not pass for evidence.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.llm.common import by_batch, texts
from riskrank.llm.near_dup import NearDup, keep_one
from riskrank.session import materialise

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
WORD_CACHE = 1 << 19
SCORED_ROWS = 1_000  # texts that a worker holds as Python objects at once
TRAIT_CACHE = 60_000
WEIGHTLESS = frozenset()


@dataclass(frozen=True)
class Fit:
    """sample: most labelled rows the fit reads, picked by a hash of the id; all others are only scored.

    evidence: least log-likelihood ratio between a trait and the document label for the
    trait to be an input. traits: most inputs, those with the most evidence. support:
    documents' worth of pull that an input's weight must outweigh to differ from zero.
    """

    sample: int = 10_000
    places: int = 1 << 22
    pieces: tuple[int, ...] = (4, 5, 6, 7)
    evidence: float = 25.0
    traits: int = 1_000
    rounds: int = 200
    support: float = 0.2
    start: float = -6.0
    limit: float = 0.7


@dataclass(frozen=True)
class Model:
    """weights: trait place to weight."""

    weights: dict
    intercept: float


def sentences(text: str) -> list[tuple[int, int]]:
    """Half-open code point spans of the stretches between sentence ends that hold a word character."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]


def traits(word: str, how: Fit) -> set[int]:
    """Places of a word and of its pieces; pieces mark the word's beginning."""
    word = word.lower()
    marked = f"^{word}"
    found = {zlib.crc32(f"={word}".encode()) % how.places}
    for size in how.pieces:
        for at in range(len(marked) - size + 1):
            found.add(zlib.crc32(marked[at:at + size].encode()) % how.places)
    return found


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def evidence(toxic: Column, spread: Column, positives: int, bags: int) -> Column:
    """Log-likelihood ratio of a trait's presence and the label; 0 for traits that speak against it."""
    def part(seen: Column, row: Column, column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen * F.lit(float(bags)) / (row * column))).otherwise(0.0)

    here, there = F.lit(float(positives)), F.lit(float(bags - positives))
    absent = F.lit(float(bags)) - spread
    ratio = (part(toxic, spread, here) + part(spread - toxic, spread, there)
             + part(here - toxic, absent, here) + part(there - spread + toxic, absent, there))
    return F.when(toxic * bags > spread * positives, ratio).otherwise(0.0)


def _probability(z: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)


def fit_bags(counts: np.ndarray, sentence: np.ndarray, inputs: np.ndarray, y: np.ndarray, width: int,
             how: Fit) -> tuple[np.ndarray, float]:
    """Weights and intercept: accelerated proximal gradient on the mean document loss with an absolute penalty.

    ``counts``: sentences per document, none without; ``sentence`` and ``inputs``: the
    sentence and trait of each occurrence, once per sentence.
    """
    total, heads = int(counts.sum()), np.concatenate([[0], np.cumsum(counts)[:-1]])
    share, penalty = 1 / len(counts), how.support / len(counts)

    def loss(w: np.ndarray, slope: bool):
        p = _probability(np.bincount(sentence, w[inputs], total)[:total] + w[-1])
        quiet = np.add.reduceat(np.log1p(-p), heads)  # log that no sentence is toxic
        clear = np.exp(quiet)
        value = -share * np.where(y == 1, np.log(np.maximum(1 - clear, 1e-12)), quiet).sum()
        if not slope:
            return value
        pull = np.where(y == 1, -clear / np.maximum(1 - clear, 1e-9), 1.0) * share
        each = p * np.repeat(pull, counts)
        return value, np.append(np.bincount(inputs, each[sentence], width)[:width], each.sum())

    now = np.append(np.zeros(width), how.start)
    # Traits of many sentences curve the loss more: each coordinate has a step of its own.
    metric = np.append(np.maximum(np.bincount(inputs, minlength=width)[:width], 1) * share, 1.0)
    ahead, momentum, step = now, 1.0, 1.0
    for _ in range(how.rounds):
        value, slope = loss(ahead, True)
        while True:
            after = ahead - step * slope / metric
            after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - step * penalty / metric[:-1], 0)
            moved = after - ahead
            if step < 1e-6 or loss(after, False) <= \
                    value + slope @ moved + (metric * moved) @ moved / (2 * step) + 1e-12:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        if (metric * (ahead - after)) @ (after - now) > 0:  # overshot: begin anew
            following = 1.0
        ahead = after + (momentum - 1) / following * (after - now)
        now, momentum, step = after, following, step * 1.3
    return now[:-1], float(now[-1])


class _Traits(dict):
    """Places of the traits of words, remembered; emptied when full."""

    def __init__(self, how: Fit, chosen: dict | None = None):
        super().__init__()
        self.how, self.chosen = how, chosen

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= TRAIT_CACHE:
            self.clear()
        found = traits(word, self.how)
        if self.chosen is not None:
            found = {self.chosen[t] for t in found if t in self.chosen}
        kept = self[word] = sorted(found)
        return kept


def count_traits(batch: pa.RecordBatch, known: _Traits) -> dict:
    """Per trait: the texts of the batch that have it, and the sum of their labels.

    Counted in place: the traits of all the texts side by side would take many times the texts' size.
    """
    found, toxic = np.zeros(known.how.places, np.int32), np.zeros(known.how.places, np.int64)
    for text, mark in zip(batch.column("text"), batch.column("toxic")):
        own: set[int] = set()
        for word in set(WORD.findall(text.as_py())):
            own.update(known[word])
        places = np.fromiter(own, np.int64, len(own))
        found[places] += 1
        toxic[places] += mark.as_py()
    places = np.flatnonzero(found)
    return {"trait": pa.array(places), "spread": pa.array(found[places].astype(np.int64)),
            "toxic": pa.array(toxic[places])}


def sample_rows(df: DataFrame, labels: DataFrame, how: Fit, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, text, toxic): at most ``how.sample`` labelled documents that are not held out."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample)
    # At most how.sample rows of 12 bytes.
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit_toxicity(df: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id",
                 text_col: str = "text") -> Model:
    """Model fitted on a bounded sample of labelled rows that are not held out.

    Null labels and ids are left out; an id labelled twice is toxic if any label says
    so. Without toxic labels no trait is chosen and every score is near zero. The driver
    gets the chosen traits and their places in the sample's sentences.
    """
    rows = materialise(sample_rows(df, labels, how, id_col, text_col), "labelled")
    single = materialise(keep_one(rows.select("doc_id", "text", "toxic"), NearDup()), "single")
    sizes = single.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    bags, positives = int(sizes.n), int(sizes.toxic or 0)
    if not positives or positives == bags:
        return Model({}, how.start)
    known = _Traits(how)

    # Traits that no toxic document has are of no use and stay behind.
    counted = by_batch(single.select("text", "toxic"), lambda batch: count_traits(batch, known),
                       "trait long, spread long, toxic long") \
        .groupBy("trait").agg(F.sum("spread").alias("spread"), F.sum("toxic").alias("toxic")).where("toxic > 1")
    best = counted.withColumn("evidence", evidence(F.col("toxic"), F.col("spread"), positives, bags)) \
        .where(F.col("evidence") >= how.evidence).orderBy(F.desc("evidence"), "trait").limit(how.traits)
    chosen = {r.trait: i for i, r in enumerate(sorted(best.collect(), key=lambda r: r.trait))}
    if not chosen:
        return Model({}, how.start)
    used = _Traits(how, chosen)

    def placed(batch: pa.RecordBatch) -> dict:
        counts, at, which = [], [], []
        for text in batch.column("text").to_pylist():
            spans = sentences(text)
            pairs = {(s, t) for s, (a, b) in enumerate(spans) for w in WORD.findall(text[a:b]) for t in used[w]}
            counts.append(len(spans))
            at.append([s for s, _ in sorted(pairs)])
            which.append([t for _, t in sorted(pairs)])
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                "sentences": pa.array(counts, pa.int32()), "at": pa.array(at, pa.list_(pa.int32())),
                "which": pa.array(which, pa.list_(pa.int32()))}

    # Bounded by the sample: a few occurrences per document.
    held = sorted(by_batch(single.select("doc_id", "text", "toxic"), placed,
                           "doc_id long, toxic int, sentences int, at array<int>, which array<int>")
                  .where("sentences > 0").collect(), key=lambda r: (r.doc_id, r.sentences, r.which))
    counts = np.array([r.sentences for r in held])
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sentence = np.concatenate([np.array(r["at"], np.int64) + f for r, f in zip(held, firsts)])
    inputs = np.concatenate([np.array(r.which, np.int64) for r in held])
    weights, intercept = fit_bags(counts, sentence, inputs, np.array([r.toxic for r in held]), len(chosen), how)
    return Model({t: float(weights[i]) for t, i in chosen.items() if weights[i]}, intercept)


class _Weights(dict):
    """Summed weights of words, remembered; emptied when full."""

    def __init__(self, model: Model, how: Fit):
        super().__init__()
        self.model, self.how = model, how

    def __missing__(self, word: str) -> frozenset:
        if len(self) >= WORD_CACHE:
            self.clear()
        # Most words have none, and share one empty set.
        kept = self[word] = frozenset(t for t in traits(word, self.how) if t in self.model.weights) or WEIGHTLESS
        return kept


def score_text(text: str, model: Model, known: _Weights) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(probability of each sentence, spans)."""
    spans = sentences(text)
    z = np.full(len(spans), model.intercept)
    for at, (a, b) in enumerate(spans):
        marks = frozenset().union(*map(known.__getitem__, WORD.findall(text, a, b)))
        if marks:
            z[at] += sum(model.weights[t] for t in sorted(marks))
    return _probability(z), spans


def score_toxicity(df: DataFrame, model: Model, how: Fit = Fit(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_offending, worst_start, worst_end, worst_score), one row per input row.

    Offending sentences are those at or above the limit; the worst one's span counts
    code points. A text without words, null ones included, scores 0 and has no worst
    sentence. Only the text counts, so null and repeated ids are scored like others.
    """
    known = _Weights(model, how)

    def score(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch.column("text").to_pylist():
            p, spans = score_text(text, model, known)
            if not len(p):
                rows.append((0.0, 0, 0, None, None, None))
                continue
            total = float(-np.expm1(np.log1p(-p).sum()))
            worst = int(p.argmax())
            rows.append((total, int(total >= how.limit), int((p >= how.limit).sum()), *spans[worst], float(p[worst])))
        kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        names = ["score", "predicted", "n_offending", "worst_start", "worst_end", "worst_score"]
        return {"doc_id": batch.column("doc_id"),
                **{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)}}

    return by_batch(texts(df, id_col, text_col), score, "doc_id long, score double, predicted int, n_offending int, "
                    "worst_start int, worst_end int, worst_score double", SCORED_ROWS)


def drop_toxic(df: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Rows whose document is not predicted toxic; rows with a null id stay.

    The ids to drop are written before the rows meet them: no executor scores texts and
    shuffles rows at the same time, and few ids are sent to the rows, which then stay
    where they are.
    """
    model = fit_toxicity(df, labels, how, id_col, text_col)
    toxic = materialise(score_toxicity(df, model, how, id_col, text_col).where("predicted = 1 and doc_id is not null")
                        .select(F.col("doc_id").alias("_toxic_id")).distinct(), "toxic-ids")
    return df.join(toxic, F.col(id_col) == F.col("_toxic_id"), "left_anti")
