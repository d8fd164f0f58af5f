"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A batch of words is one flat array of symbols. In each round every word finds its
best pair (a segmented minimum of the pairs' ranks), merges all its occurrences
from the left, and the array is compacted; words without a pair leave it. The
library merges one pair at a time over the whole text: a pair that a merge brings
forth and that ranks no worse comes before the next occurrence. So a word's merges
of a round end with the first one that brings forth such a pair.

Words are what lies between spaces, each with one space mark in front: a piece has
the mark at its front only, or consists of marks. Pieces of marks alone rank last,
so runs of marks are merged by themselves after everything else; how a run
merges depends on its length only. Long words are cut where two neighbours stand
side by side in no piece, as no merge can bridge such a place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from riskrank.llm.common import Strings, by_batch, texts

MARK = "▁"
UNKNOWN_TEXT = " ⁇ ".encode()  # fixed value: what the library writes for the unknown id
NO_PAIR = np.iinfo(np.int32).max
SLICE_CHARS = 2_000_000  # texts are encoded together up to so many characters
KNOWN_WORDS = 300_000
KNOWN_LETTERS = 64  # longer words are encoded anew each time


class PieceModel:
    """The pieces of a model file and the pairs that make them.

    Symbols are piece ids; a character that is no piece is ``size`` plus its code
    point and ends as the pieces of its bytes. Models other than BPE with byte
    fallback, a leading space mark and unchanged texts are refused.
    """

    def __init__(self, path: str):
        library = SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (
            library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.first_byte = next((i for i in range(self.size) if library.is_byte(i)), -1)
        if self.first_byte < 0 or library.is_unused(self.first_byte):
            raise ValueError("the model has no pieces for bytes")
        if any(MARK in pieces[i][1:] and set(pieces[i]) != {MARK} for i in plain):
            raise ValueError("a piece holds a space mark behind its front")

        self.symbol_of = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for i in plain:
            if len(pieces[i]) == 1:
                self.symbol_of[ord(pieces[i])] = i
        self.mark = int(self.symbol_of[ord(MARK)])
        self.span = self.size + 0x110000

        scores = np.array([library.get_score(i) for i in range(self.size)])
        ranks = np.unique(-scores, return_inverse=True)[1]  # best score first, equal scores alike
        number = {pieces[i]: i for i in plain}
        runs: dict[int, int] = {}
        keys, made, beside = [], [], set()
        for i in plain:
            piece = pieces[i]
            if len(piece) < 2:
                continue
            if set(piece) == {MARK}:
                runs[len(piece)] = i
                continue
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                halves = [number.get(h, -1) if len(h) > 1 else int(self.symbol_of[ord(h)])
                          for h in (piece[:cut], piece[cut:])]
                if min(halves) >= 0:
                    keys.append(halves[0] * self.span + halves[1])
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.made_rank = ranks[self.made].astype(np.int32)
        self.beside = np.array(sorted(beside), np.int64)

        worst = max((int(ranks[i]) for i in self.made), default=-1)
        if any(ranks[i] <= worst for i in runs.values()):
            raise ValueError("pieces of space marks do not rank last")
        self.runs, self.run_rank = runs, {n: int(ranks[i]) for n, i in runs.items()}
        self._run_ids: dict[int, bytes] = {}
        self._known: dict[str, tuple[bytes, bool]] = {}

        written = [b""] * self.size
        for i in plain:
            written[i] = pieces[i].replace(MARK, " ").encode()
        for i in range(self.size):
            if library.is_byte(i):
                written[i] = bytes([int(pieces[i][3:5], 16)])
            elif library.is_unknown(i):
                written[i] = UNKNOWN_TEXT
        self.is_byte = np.array([library.is_byte(i) for i in range(self.size)])
        self.written = Strings(written)
        self.decimal = Strings([b"%d," % i for i in range(self.size)])
        self.probe = _run_period(self)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that two symbols make; NO_PAIR where they make none."""
        wanted = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.made_rank[at], NO_PAIR), self.made[at]

    # Rounds ---------------------------------------------------------------

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, and where each word begins; no word holds two marks side by side."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word_starts = np.cumsum(lengths) - lengths
        if not len(codes):
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        # Cut where two characters stand side by side in no piece.
        start = np.zeros(len(codes), bool)
        start[word_starts[lengths > 0]] = True
        if len(self.beside):
            two = codes[:-1] << 21 | codes[1:]
            at = np.minimum(np.searchsorted(self.beside, two), len(self.beside) - 1)
            start[1:] |= self.beside[at] != two
        places, symbols = self._rounds(self.symbol_of[codes], start)
        return symbols, np.searchsorted(places, np.append(word_starts, len(codes)))

    def _rounds(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first character, symbol) of what remains, in order of place."""
        place = np.arange(len(symbols))
        rank, made = np.full(len(symbols), NO_PAIR, np.int32), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(~start[1:])
        rank[inner], made[inner] = self.pair(symbols[inner], symbols[inner + 1])
        done_places, done_symbols = [], []
        while len(symbols):
            heads = np.flatnonzero(start)
            least = np.minimum.reduceat(rank, heads)
            live = least < NO_PAIR
            sizes = np.diff(np.append(heads, len(symbols)))
            if not live.all():  # words without a pair leave
                staying = np.repeat(live, sizes)
                done_places.append(place[~staying])
                done_symbols.append(symbols[~staying])
                symbols, place, start = symbols[staying], place[staying], start[staying]
                rank, made = rank[staying], made[staying]
                if not len(symbols):
                    break
                sizes, least = sizes[live], least[live]
            segment = np.repeat(np.arange(len(sizes)), sizes)
            hit = rank == least[segment]
            # Of overlapping occurrences every second one, from the left.
            places = np.flatnonzero(hit)
            first = np.ones(len(places), bool)
            first[1:] = places[1:] != places[:-1] + 1
            run_start = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
            places = places[(places - run_start) % 2 == 0]
            places = self._until_better(places, symbols, start, rank, made, segment)

            symbols[places] = made[places]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            where = (np.cumsum(keep) - 1)[places]
            symbols, place, start, rank, made = symbols[keep], place[keep], start[keep], rank[keep], made[keep]
            changed = np.concatenate([where, where[~start[where]] - 1])
            last = np.append(start[1:], True)[changed]
            rank[changed[last]] = NO_PAIR
            changed = changed[~last]
            rank[changed], made[changed] = self.pair(symbols[changed], symbols[changed + 1])
        if not done_places:
            return place, symbols
        places, kept = np.concatenate(done_places), np.concatenate(done_symbols)
        order = np.argsort(places, kind="stable")
        return places[order], kept[order]

    def _until_better(self, places, symbols, start, rank, made, segment) -> np.ndarray:
        """The merges up to the first in each word that brings forth a pair of no worse rank."""
        several = np.zeros(len(places), bool)
        same = segment[places[1:]] == segment[places[:-1]]
        several[:-1] = same
        if not several.any():
            return places
        asked = places[several]  # only a merge with another one behind it in its word can hold that one up
        new = made[asked]
        after = self.pair(new, symbols[asked + 2])[0]
        # To the left stands the piece just made, if the merge before ends there.
        before_places = asked - 1
        merged_before = np.isin(asked - 2, places, assume_unique=True) if len(asked) else np.empty(0, bool)
        left = np.where(merged_before, made[np.maximum(asked - 2, 0)], symbols[np.maximum(before_places, 0)])
        before = np.where(start[asked], NO_PAIR, self.pair(left, new)[0])
        held = np.minimum(after, before) <= rank[asked]
        if not held.any():
            return places
        blocked = np.full(int(segment[-1]) + 1, len(symbols))
        np.minimum.at(blocked, segment[asked[held]], asked[held])
        return places[places <= blocked[segment[places]]]

    # Words, runs and texts --------------------------------------------------

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each became: a character that is no piece ends as the pieces of its bytes."""
        odd = symbols >= self.size
        sizes = np.ones(len(symbols), np.int64)
        if not odd.any():
            return symbols, sizes
        chars, which = np.unique(symbols[odd], return_inverse=True)
        table = Strings([chr(c - self.size).encode("utf-8", "surrogatepass") for c in chars.tolist()])
        sizes[odd] = table.sizes[which]
        out = np.repeat(symbols, sizes)
        out[np.repeat(odd, sizes)] = table.gather(which)[0].astype(np.int64) + self.first_byte
        return out, sizes

    def run(self, length: int) -> bytes:
        """Ids of a run of space marks that nothing else took."""
        found = self._run_ids.get(length)
        if found is None:
            rest, head = length, []
            if self.probe and length >= 3 * self.probe:
                times = length // self.probe - 2
                head = [self.runs[self.probe]] * times
                rest -= times * self.probe
            found = np.array(head + [self.runs[n] if n > 1 else -1 for n in self.run_lengths(rest)], np.int64)
            found = self._ids(np.where(found < 0, self.mark, found))[0].astype("<i4").tobytes()
            if length <= 4096:
                self._run_ids[length] = found
        return found

    def run_lengths(self, length: int) -> list[int]:
        """Lengths of the pieces of a run, one merge after the other as the library makes them."""
        parts = [1] * length
        while True:
            best = min(((self.run_rank[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.run_rank), default=None)
            if best is None:
                return parts
            at = best[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bool]]:
        """(ids, whether the first is a space mark alone) of words that begin with a mark."""
        if not words:
            return {}
        symbols, bounds = self.merge(words)
        alone = symbols[bounds[:-1]] == self.mark
        ids, sizes = self._ids(symbols)
        ends = 4 * np.append(0, np.cumsum(sizes))[bounds]
        flat, ends = ids.astype("<i4").tobytes(), ends.tolist()
        return {word: (flat[a:b], mark) for word, a, b, mark in zip(words, ends, ends[1:], alone.tolist())}

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers; an empty text has none."""
        cut = [(MARK + t.replace(" ", MARK)).split(MARK) if t else [] for t in batch]
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        fresh = self._learn([w for w in {MARK + p for parts in cut for p in parts if p} if w not in known])
        known.update(fresh)
        out = []
        for parts in cut:
            ids, spare = [], 0  # spare: marks before the one that belongs to the next word
            for part in parts[1:]:
                if not part:
                    spare += 1
                    continue
                word, alone = known[MARK + part]
                if spare:
                    ids.append(self.run(spare + alone))
                    word = word[self._mark_bytes:] if alone else word
                    spare = 0
                ids.append(word)
            if spare:
                ids.append(self.run(spare))
            out.append(b"".join(ids))
        for word in fresh:
            if len(word) > KNOWN_LETTERS:
                del known[word]
        return out

    @property
    def _mark_bytes(self) -> int:
        return 4 if self.mark < self.size else 4 * len(MARK.encode())

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ids: the mark in front goes, bytes that are no UTF-8 become U+FFFD each."""
        flat, ends = self.written.gather(ids)
        data = flat.tobytes()
        if self.is_byte[ids].any():
            try:
                data.decode()
            except UnicodeDecodeError:
                data = self._mended(ids, data, ends)
        # Only a plain piece loses its mark; a byte is text even if it is a space.
        return data[1:] if len(ids) and not self.is_byte[ids[0]] and data[:1] == b" " and \
            ids[0] != 0 else data

    def _mended(self, ids: np.ndarray, data: bytes, ends: np.ndarray) -> bytes:
        out, at, starts = [], 0, np.append(0, ends)
        is_byte = self.is_byte[ids]
        while at < len(ids):
            to = at + 1
            while to < len(ids) and is_byte[to] == is_byte[at]:
                to += 1
            part = data[starts[at]:starts[to]]
            out.append(_replaced(part) if is_byte[at] else part)
            at = to
        return b"".join(out)


def _replaced(data: bytes) -> bytes:
    """Each byte that begins no code point becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size if at + size <= len(data) else len(data) - at
            break
        else:
            out.append("�")
            at += 1
    return "".join(out).encode()


def _run_period(model: PieceModel) -> int:
    """The longest piece of marks, if longer runs begin with it and go on as the rest would by itself; else 0."""
    longest = max(model.runs, default=0)
    for length in range(longest, 3 * longest + 1):
        if model.run_lengths(length) != [longest] + model.run_lengths(length - longest):
            return 0
    return longest


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    return PieceModel(path)


def _slices(batch: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for text in batch:
        part.append(text)
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids), ids being little-endian 32-bit integers without begin or end ids.

    Null and empty texts have no ids. ``path`` must be readable on every executor.
    Rows are treated one by one, so null and repeated ids change nothing.
    """
    def build(batch: pa.RecordBatch) -> dict:
        model, made = piece_model(path), []
        for part in _slices(batch.column("text").to_pylist()):
            made += model.encode_batch(part)
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "ids": pa.array(made, pa.binary())}

    return by_batch(texts(df, id_col, text_col), build, "doc_id long, text string, ids binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids in decimal joined by commas, and what they decode to."""
    def build(batch: pa.RecordBatch) -> dict:
        model, counts, id_hashes, text_hashes = piece_model(path), [], [], []
        for part in _slices(batch.column("text").to_pylist()):
            for made in model.encode_batch(part):
                ids = np.frombuffer(made, "<i4")
                decimal = model.decimal.gather(ids)[0].tobytes()[:-1]
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(decimal).hexdigest())
                text_hashes.append(hashlib.sha256(model.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(id_hashes, pa.string()), "decoded_sha256": pa.array(text_hashes, pa.string())}

    return by_batch(texts(df, id_col, text_col), build,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
