"""Quality by divergence from language references.

The reference of a language holds two histograms over all documents that name
it: character classes, and its most frequent words with one place for all other
words. A document is compared with its language's reference (with the nearest
one where it names none that has a reference) by Jensen-Shannon distance, and
is rejected when either distance is above its limit. Texts below the length
guards are not judged by the histogram that needs more.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskrank.llm.common import by_batch, utf8
from riskrank.session import materialise

WORD_CACHE = 1 << 19
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?\"'()-"


@dataclass(frozen=True)
class Quality:
    """Distances are square roots of the divergence in bits, so between 0 and 1."""

    common_words: int = 64
    class_limit: float = 0.25
    word_limit: float = 0.5
    least_chars: int = 200
    least_words: int = 50


CLASS_NAMES = ["lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond"]


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a code point get the place past the last class."""
    kinds = np.full(256, 6, np.int64)
    kinds[ord("a"):ord("z") + 1] = 0
    kinds[ord("A"):ord("Z") + 1] = 1
    kinds[ord("0"):ord("9") + 1] = 2
    kinds[[32, *range(9, 14)]] = 3
    kinds[list(STOPS)] = 4
    kinds[list(SYMBOLS)] = 5
    kinds[128:192] = 8
    kinds[192:] = 7
    return kinds


CLASSES = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=9)[:8]


class _Bare(dict):
    """Words in lower case without the stops at their ends, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        bare = self[word] = word.lower().strip(STOPS)
        return bare


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split()
    symbols = sum(text.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    chars = int(class_counts(text).sum()) - sum(text.count(s) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = Counter(line for line in text.split(b"\n") if line.split())
    return len(words), chars, symbols, sum(lines.values()) - len(lines), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) < width + 1:
        return 0
    numbers: dict[bytes, int] = {}
    places = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = places
    for step in range(1, width):
        _, key = np.unique((key[:-1] << 32) | places[step:], return_inverse=True)
    often = np.bincount(key)[key] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence of two histograms, in bits."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


@dataclass(frozen=True)
class References:
    """languages: name to (class histogram, word to place, word histogram with the rest last)."""

    languages: dict


def fit_references(df: DataFrame, how: Quality = Quality(), text_col: str = "text",
                   lang_col: str = "lang") -> References:
    """Count classes and words over all documents that name a language.

    Counts are combined per batch and then by Spark; what reaches the driver is
    ``common_words`` rows a language. Null texts count nothing.
    """
    bare = _Bare()

    def count(batch: pa.RecordBatch) -> dict:
        words: dict[str, Counter] = {}
        kinds: dict[str, np.ndarray] = {}
        for text, lang in zip(utf8(batch), batch.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(map(bare.__getitem__, text.split()))
            kinds[lang] = kinds.get(lang, 0) + class_counts(text)
        rows = [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items() if w]
        rows += [(lang, "class", b"%d" % i, int(n)) for lang, k in kinds.items() for i, n in enumerate(k)]
        rows += [(lang, "all", b"", sum(c.values())) for lang, c in words.items()]
        lang, kind, key, n = zip(*rows) if rows else ((), (), (), ())
        return {"lang": pa.array(lang, pa.string()), "kind": pa.array(kind, pa.string()),
                "key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64())}

    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialise(by_batch(known, count, "lang string, kind string, key binary, n long")
                         .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "reference")
    # The most frequent words per language: first within slices, so that no task orders a vocabulary.
    order = [F.col("n").desc(), F.col("key")]
    words = counts.where("kind = 'word'").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(64)))
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))) \
        .where(F.col("r") <= how.common_words) \
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .where(F.col("r") <= how.common_words)
    rows = top.select("lang", "kind", "key", "n").union(
        counts.where("kind != 'word'").select("lang", "kind", "key", "n")).collect()
    languages = {}
    for lang in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == lang]
        kinds = np.zeros(8)
        for r in own:
            if r.kind == "class":
                kinds[int(bytes(r.key))] = r.n
        common = sorted(((bytes(r.key), r.n) for r in own if r.kind == "word"), key=lambda x: (-x[1], x[0]))
        total = sum(r.n for r in own if r.kind == "all")
        if kinds.sum() and total:
            weights = np.array([n for _, n in common] + [total - sum(n for _, n in common)], float)
            languages[lang] = (kinds, {w: i for i, (w, _) in enumerate(common)}, weights)
    return References(languages)


def divergences(text: bytes, lang: str | None, refs: References, bare: _Bare) -> tuple[float, float]:
    """(class distance, word distance) of a text from its language, or from the nearest one; nan if it has none."""
    kinds, words = class_counts(text), Counter(map(bare.__getitem__, text.split()))
    if not kinds.sum() or not words or not refs.languages:
        return float("nan"), float("nan")
    chosen = [refs.languages[lang]] if lang in refs.languages else list(refs.languages.values())
    best = []
    for own, places, weights in chosen:
        histogram = np.zeros(len(weights))
        for word, n in words.items():
            histogram[places.get(word, -1)] += n
        best.append((js_distance(histogram, weights), js_distance(kinds, own)))
    word, kind = min(best)
    return kind, word


def judge_documents(df: DataFrame, refs: References, how: Quality = Quality(), id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: counts, base verdict, both distances and the verdict ``kept``.

    A null or empty text has no words and fails the base rules; its distances are
    null. Null ids and repeated rows are judged like any other.
    """
    bare = _Bare()

    def judge(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words", "base_failed", "kept", "class_distance",
                                                "word_distance")}
        for text, lang in zip(utf8(batch), batch.column("lang").to_pylist()):
            base = base_counts(text)
            words, chars, _, _, repeated = base
            failed = words < 50 or 100 * repeated > 50 * words
            kind, word = divergences(text, lang, refs, bare)
            far = (chars >= how.least_chars and kind > how.class_limit) or \
                (words >= how.least_words and word > how.word_limit)
            for name, value in zip(out, (*base, failed, not failed and not far,
                                         None if kind != kind else kind, None if word != word else word)):
                out[name].append(value)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return {"doc_id": batch.column("doc_id"),
                **{name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.col(lang_col).cast("string").alias("lang"))
    return by_batch(rows, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                    "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, "
                    "word_distance double")
