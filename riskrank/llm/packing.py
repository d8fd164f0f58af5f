"""Best-fit packing of documents into fixed-length sequences by bin completion.

Documents longer than a sequence are cut into whole sequences and a rest. What
matters for packing is only how many pieces there are of each length, so the
search works on that histogram, which has at most ``limit`` entries whatever
the corpus holds: branch and bound over bins, each bin being the largest piece
left and an undominated filling around it, pruned by the waste that the
incumbent still allows. The first incumbent is best fit.

The result is a table of runs: so many pieces of one length, from rank r on, go
to bins from number b on at one offset. Ranks inside a length are running totals
over hashed slices, so no length's pieces meet in one task.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskrank.llm.common import by_batch, kept_by_worker, texts
from riskrank.session import materialise

WORD_CACHE = 900_000
CACHED_CHARS = 64
CUT_ROWS = 1_000  # texts that a worker holds as Python objects at once
CHUNK_CHARS = 1 << 20
JOINED = 64
TAIL = ".,!?;:"
BAR = "|"
LATIN_END = "\u0250"  # letters below were letters in every version of Unicode
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, but not to the vocabulary


@dataclass(frozen=True)
class Packing:
    limit: int = 2048
    end_id: int = 0
    slice_rows: int = 1_000_000
    branches: int = 64  # fillings tried around a piece, those with the least waste first
    nodes: int = 20_000  # bins completed before the search settles for its incumbent


def _stays_letter(last: str) -> bool:
    """Whether a letter still ends in a letter, not in a mark, once it is composed and in lower case."""
    return last.isalpha() and (last.isascii() or unicodedata.normalize("NFC", last).lower()[-1].isalpha())


class Coder:
    """Ids of texts, by words: a vocabulary that drops white space never joins ids across it.

    Words met before are looked up. A new word is a stem and the stops behind it, and
    stems are coded by the tokenizer, many in one call: every word of letters ends in
    a token that carries the vocabulary's word end, which tells them apart again.
    Texts that hold an added token go whole through the tokenizer as the file has it.
    """

    def __init__(self, path: str):
        # A task has one core; more threads only leave a heap each, of which little is given back.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.uncut = [*ODD_SPACE, *(token.content for token in self.whole.get_added_tokens_decoder().values())]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a stem is in lower case, its word may hold no added token
        # Words of letters are as the splitter would leave them.
        own = json.loads(self.tokenizer.to_str())
        self.letters = Tokenizer.from_str(json.dumps(own | {
            "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]},
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}))
        self.bare = Tokenizer.from_str(json.dumps(own | {
            "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.letters.encode_special_tokens = self.bare.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None

    def _coded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _coded_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> list[str]:
        """Adds words to those known, and their stems, which are words too. Returns the long ones among them."""
        known = self.known
        parts, stems = [], set()
        for word in words:
            if word.isascii() and word.isalpha():
                stem, tail = word.lower(), ""
            else:
                stem = word.rstrip(TAIL)
                # Stops right behind a letter are a piece of their own.
                if stem and _stays_letter(stem[-1]):
                    stem, tail = stem.lower() if stem.isascii() else stem, word[len(stem):]
                else:
                    stem, tail = word, ""
            if tail:
                parts.append((word, stem, tail))
                stems.add(tail)
            elif stem != word:
                parts.append((word, stem, tail))
            stems.add(stem)
        fresh = stems.difference(known)
        alpha = [s for s in fresh if s.isalpha()]
        self._learn_letters([s for s in alpha if s.isascii()], self.bare)
        self._learn_letters([s for s in alpha if not s.isascii() and max(s) < LATIN_END and s.lower().isalpha()],
                            self.letters)
        self._learn_letters([s for s in alpha if s not in known], self.tokenizer)
        self._learn_others([s for s in fresh if s not in known])
        for word, stem, tail in parts:
            known[word] = known[stem] + known[tail] if tail else known[stem]
        return [w for w in (*words, *fresh) if len(w) > CACHED_CHARS]

    def _learn_letters(self, fresh: list[str], tokenizer: Tokenizer) -> None:
        """Words of letters alone: each ends in the first token that carries the word end."""
        known = self.known
        for group, ids in self._coded_groups(fresh, " ", tokenizer):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                data, begin = ids.tobytes(), 0
                for word, cut in zip(group, (4 * cuts).tolist()):
                    known[word] = data[begin:cut]
                    begin = cut

    def _learn_others(self, fresh: list[str]) -> None:
        """Any words: those without a bar are told apart by bars between them, the rest are coded one by one."""
        known = self.known
        if self.bar is not None:
            for group, ids in self._coded_groups([s for s in fresh if BAR not in s], f" {BAR} ", self.tokenizer):
                bars = np.flatnonzero(ids == self.bar)
                if len(bars) == len(group) - 1:
                    data, begin = ids.tobytes(), 0
                    for word, at in zip(group, (4 * np.append(bars, len(ids))).tolist()):
                        known[word] = data[begin:at]
                        begin = at + 4
        for word in fresh:
            if word not in known:
                known[word] = self._coded(word)

    @staticmethod
    def _coded_groups(words: list[str], between: str, tokenizer: Tokenizer) -> Iterable[tuple[list[str], np.ndarray]]:
        groups = [words[at:at + JOINED] for at in range(0, len(words), JOINED)]
        coded = tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        return zip(groups, (np.array(c.ids, "<u4") for c in coded))

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if any(mark in t for mark in self.uncut) else t.split() for t in texts]
        known, words = self.known, set().union(*filter(None, split))
        if len(known) > WORD_CACHE:
            known.clear()
        long = self._learn(words.difference(known))
        out = [self._coded_whole(t) if words is None else b"".join([known[w] for w in words])
               for t, words in zip(texts, split)]
        for word in long:  # they serve this chunk only
            known.pop(word, None)
        return out

    def chunks(self, texts: list[str]) -> Iterable[bytes]:
        """As ``all_ids``, in stretches that bound the words held at once."""
        held, weight = [], 0
        for text in texts:
            held.append(text)
            weight += len(text)
            if weight >= CHUNK_CHARS:
                yield from self.all_ids(held)
                held, weight = [], 0
        yield from self.all_ids(held)


def _key(path: str) -> tuple[str, str]:
    return "word ids", path


def coder(path: str) -> Coder:
    """One per Python worker and vocabulary, as long as the worker's tasks cut pieces."""
    return kept_by_worker(_key(path), lambda: Coder(path))


def cut_pieces(df: DataFrame, path: str, how: Packing = Packing(), with_ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and the end id behind them.

    Only documents longer than the limit are cut. A null or empty text is one piece
    that holds the end id. Rows are cut one by one, so repeated rows give pieces each.
    """
    end = np.array([how.end_id], "<u4")

    def build(batch: pa.RecordBatch) -> dict:
        found = coder(path).chunks(batch.column("text").to_pylist())
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, coded in zip(batch.column("doc_id").to_pylist(), found):
            ids = np.concatenate([np.frombuffer(coded, "<u4"), end])
            for piece, start in enumerate(range(0, len(ids), how.limit)):
                part = ids[start:start + how.limit]
                data = part.tobytes()
                for name, value in zip(out, (doc, piece, start, len(part), zlib.crc32(data),
                                             data if with_ids else None)):
                    out[name].append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return by_batch(texts(df, id_col, text_col), build, schema + (", ids binary" if with_ids else ""),
                    CUT_ROWS, _key(path))


def _fillings(lengths: list[int], counts: dict[int, int], room: int, most_waste: int, width: int) -> list[tuple]:
    """Undominated fillings of ``room``: (waste, pieces, largest first), least waste first.

    A filling is dominated if a piece that is left would still fit, or if one piece of
    another, at most as large, could be exchanged for several of it: so the search takes
    pieces in falling order and, for the last place, only the largest that fits.
    """
    found: dict[tuple, int] = {}
    left = dict(counts)
    budget = [width * 40]

    def largest(most: int) -> int:
        at = bisect.bisect_right(lengths, most) - 1
        while at >= 0 and not left[lengths[at]]:
            at -= 1
        return at

    def extend(taken: tuple, room: int, below: int) -> None:
        if budget[0] <= 0 or (found and min(found.values()) == 0 and len(found) >= width):
            return
        budget[0] -= 1
        at = largest(min(room, below))
        if at < 0:
            if largest(room) < 0 and room <= most_waste:
                found.setdefault(taken, room)
            return
        tried = 0
        while at >= 0 and tried < 6:
            size = lengths[at]
            left[size] -= 1
            extend((*taken, size), room - size, size)
            left[size] += 1
            tried += 1
            at = largest(size - 1)

    # One piece that fills the room, or two that do, dominate all else.
    if left.get(room, 0):
        return [(0, (room,))]
    for first in reversed(lengths[bisect.bisect_right(lengths, room // 2):bisect.bisect_left(lengths, room)]):
        rest = room - first
        if left[first] and left.get(rest, 0) - (rest == first) > 0:
            found[(first, rest)] = 0
            if len(found) >= 4:
                break
    half = room // 2
    if room % 2 == 0 and left.get(half, 0) >= 2:
        found[(half, half)] = 0
    if not found:
        extend((), room, room)
    return sorted((waste, taken) for taken, waste in found.items())[:width]


def _multiplicity(pieces: tuple, counts: dict[int, int]) -> int:
    """How many bins of this filling the counts allow."""
    return min(counts[size] // pieces.count(size) for size in set(pieces))


def lower_bound(histogram: dict[int, int], limit: int) -> int:
    """Bins needed at least: by volume, and by pieces no two of which fit together, over all thresholds."""
    total = -(-sum(s * n for s, n in histogram.items()) // limit)
    sizes = sorted(histogram)
    best = total
    for small in range(0, limit // 2 + 1, max(1, limit // 64)):
        large = sum(n for s, n in histogram.items() if s > limit - small)
        middle = [(s, n) for s, n in histogram.items() if limit // 2 < s <= limit - small]
        rest = sum(s * n for s, n in histogram.items() if small <= s <= limit // 2)
        free = sum((limit - s) * n for s, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(rest - free) // limit)))
    return best if sizes else 0


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[tuple, int]]:
    """(pieces, bins) by best fit, largest first, on counts: equal bins are filled together."""
    counts = dict(histogram)
    lengths = sorted(counts)
    out: list[tuple[tuple, int]] = []
    while lengths:
        pieces: list[int] = []
        room = limit
        left = {}
        while True:
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and counts[lengths[at]] - left.get(lengths[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            pieces.append(lengths[at])
            left[lengths[at]] = left.get(lengths[at], 0) + 1
            room -= lengths[at]
        bins = _multiplicity(tuple(pieces), counts)
        out.append((tuple(pieces), bins))
        for size in pieces:
            counts[size] -= bins
        lengths = [s for s in lengths if counts[s]]
    return out


def complete_bins(histogram: dict[int, int], how: Packing = Packing()) -> list[tuple[tuple, int]]:
    """(pieces, number of bins filled so), using as few bins as the search finds.

    Depth first over fillings with the least waste; a filling is taken for as many
    equal bins as the counts allow. A branch ends when the waste so far cannot lead
    below the incumbent, the search when the incumbent meets the lower bound or the
    nodes are spent, in which case the incumbent stands.
    """
    histogram = {int(s): int(n) for s, n in histogram.items() if n}
    if not histogram:
        return []
    volume = sum(s * n for s, n in histogram.items())
    bound = lower_bound(histogram, how.limit)
    incumbent = best_fit(histogram, how.limit)
    fewest = sum(n for _, n in incumbent)
    spent = 0
    # Each entry: counts left, bins so far, waste so far, fillings so far, alternatives not yet tried.
    stack = [(dict(histogram), 0, 0, None, None)]
    while stack and fewest > bound and spent < how.nodes:
        counts, used, waste, trail, options = stack.pop()
        if options is None:
            lengths = sorted(s for s, n in counts.items() if n)
            if not lengths:
                if used < fewest:
                    fewest, incumbent = used, _unwound(trail)
                continue
            top = lengths[-1]
            counts[top] -= 1
            allowed = (fewest - 1) * how.limit - volume - waste
            options = _fillings([s for s in lengths if counts[s]], counts, how.limit - top, allowed, how.branches)
            counts[top] += 1
            options = [(w, (top, *taken)) for w, taken in options]
        options = [o for o in options if waste + o[0] + volume <= (fewest - 1) * how.limit]
        if not options:
            continue
        spent += 1
        stack.append((counts, used, waste, trail, options[1:]))
        lost, pieces = options[0]
        bins = _multiplicity(pieces, counts)
        if lost:  # not so many that the waste runs over
            bins = max(1, min(bins, ((fewest - 1) * how.limit - volume - waste) // lost))
        after = dict(counts)
        for size in pieces:
            after[size] -= bins
        stack.append((after, used + bins, waste + lost * bins, (pieces, bins, trail), None))
    return incumbent


def _unwound(trail) -> list[tuple[tuple, int]]:
    out = []
    while trail is not None:
        pieces, bins, trail = trail
        out.append((pieces, bins))
    return out[::-1]


def _runs(plan: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, offset) of every place of every filling."""
    ranks: dict[int, int] = {}
    runs, first = [], 0
    for pieces, bins in plan:
        offset = 0
        for size in pieces:
            runs.append((size, ranks.get(size, 0), bins, first, offset))
            ranks[size] = ranks.get(size, 0) + bins
            offset += size
        first += bins
    return runs


def pack_pieces(pieces: DataFrame, how: Packing = Packing()) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; every row is placed, equal rows each by itself.

    ``pieces`` needs doc_id, piece and length, and is read twice, so it should be a
    written table. The driver holds one count per length and the plan made of them.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= how.limit)
    rest = pieces.where(F.col("length") < how.limit)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(n for size, n in counts.items() if size >= how.limit)
    plan = complete_bins({size: n for size, n in counts.items() if size < how.limit}, how)
    runs = [(how.limit, 0, whole, 0, 0)] if whole else []
    runs += [(s, r, n, b + whole, o) for s, r, n, b, o in _runs(plan)]
    del full, rest

    slices = {size: -(-n // how.slice_rows) for size, n in counts.items()}
    most = max(slices.values(), default=1)
    by_length = spark.createDataFrame(sorted((s, k) for s, k in slices.items()), "length long, slices int")
    marked = pieces.withColumn("_mark", F.xxhash64("doc_id", "piece"))
    if most > 1:
        marked = marked.join(F.broadcast(by_length), "length") \
            .withColumn("_slice", F.pmod("_mark", F.col("slices")).cast("int")).drop("slices")
    else:
        marked = marked.withColumn("_slice", F.lit(0))
    within = Window.partitionBy("length", "_slice").orderBy("_mark", "doc_id", "piece")
    ranked = marked.withColumn("_rank", F.row_number().over(within) - 1)
    if most > 1:
        sizes = materialise(marked.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n")), "slices")
        firsts = sizes.withColumn("_first", F.sum("n").over(
            Window.partitionBy("length").orderBy("_slice")) - F.col("n")).drop("n")
        ranked = ranked.join(F.broadcast(firsts), ["length", "_slice"]).withColumn(
            "_rank", F.col("_rank") + F.col("_first")).drop("_first")
    table: dict[int, list] = {}
    for size, rank, n, first, offset in runs:
        table.setdefault(size, []).append((rank, n, first, offset))
    # One row per length; the runs of all lengths together are as many as the plan has places.
    places = spark.createDataFrame(
        [(s, [r[0] for r in own], [r[2] for r in own], [r[3] for r in own]) for s, own in sorted(table.items())],
        "length long, ranks array<long>, bins array<long>, offsets array<long>")
    return _placed(ranked.join(F.broadcast(places), "length"), pieces.columns)


def _placed(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Look up each rank's run: the last one that begins at or before it."""
    at = F.size(F.filter("ranks", lambda r: r <= F.col("_rank"))) - 1
    return joined.withColumn("_at", at).select(
        *columns,
        (F.get("bins", F.col("_at")) + F.col("_rank") - F.get("ranks", F.col("_at"))).alias("sequence_id"),
        F.get("offsets", F.col("_at")).alias("offset"))


def pack_documents(df: DataFrame, path: str, how: Packing = Packing(), with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    pieces = materialise(cut_pieces(df, path, how, with_ids, id_col, text_col), "pieces")
    return pack_pieces(pieces, how)
