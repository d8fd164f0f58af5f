"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

``Transducer`` reads bytes and writes token ids. Reading rests on one property
of BPE: a token sequence is the encoding of its bytes exactly when every two
neighbours are (they encode to themselves when joined). So the encoding of each
prefix ends in one token only, and the encoding of a longer prefix is found from
those of the shorter ones at which a token may begin.

A state is the set of such beginnings: for each, the place in the trie of tokens
reached since, and the token that the encoding of its prefix ends in. Each byte
writes the token in which the prefix up to it ends; read backwards from the last
one, every token tells by its length where the one before it ended. States and
transitions are made when first taken and remembered; when there are too many, the
memory is emptied and refilled.

``Utf8Machine`` follows UTF-8 byte by byte; ``StreamDecoder`` turns ids into text
chunk by chunk and holds back only the bytes of an unfinished code point.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskrank.llm.common import Strings, by_batch, texts

MOST_STEPS = 1_000_000
MOST_PAIRS = 300_000
PIECE_CACHE = 400_000
CACHED_BYTES = 128  # longer pieces, such as runs of white space, are encoded anew each time
BESIDE_SPACE = re.compile(r"\A | \Z| \s|\s ")


class Transducer:
    """Encoder for ranks as tiktoken has them: the pair of least rank merges first, the leftmost of equals.

    A state is a tuple (shape * 256, token, token, ...): the shape stands for the places
    in the trie that its beginnings have reached, longest first, and the tokens are those
    before the beginnings, -1 at the front of the piece. The last beginning is that at
    the place reached. What a byte does to the places is the same for all states of a
    shape, and there are far fewer shapes than states.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._size = {i: len(t) for t, i in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._parts: tuple[dict, dict] = ({}, {})
        below: dict[int, int] = {}  # node * 256 + byte to the node below
        token_at, inner = [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                inner[node] = True
                after = below.get(node << 8 | byte)
                if after is None:
                    after = below[node << 8 | byte] = len(token_at)
                    token_at.append(-1)
                    inner.append(False)
                node = after
            if self.halves(rank) is not None:  # else merging never makes it
                token_at[node] = rank
        # What a step needs to know at once: the node below (times 256; -1 if nothing follows it) and its token or -1.
        self._edges: dict[int, tuple[int, int]] = {
            key: (node << 8 if inner[node] else -1, token_at[node]) for key, node in below.items()}
        self._reset()

    def _reset(self) -> None:
        self._shapes: list[tuple[int, ...]] = [(0,)]  # trie nodes * 256
        self._shape_of: dict[tuple[int, ...], int] = {(0,): 0}
        self._shape_steps: dict[int, tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self._states: list[tuple[int, ...]] = [(0, -1)]
        self._number: dict[tuple[int, ...], int] = {(0, -1): 0}
        self._steps: dict[int, int] = {}  # state * 256 + byte to the state after, times 256

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes a token from its own bytes; () for a byte, None if merging does not make it."""
        found = self._halves.get(token, 0)
        if found == 0:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            pair = () if len(parts) == 1 else None
            while len(parts) > 1:
                best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                            if a + b in self.ranks), default=None)
                if best is None:
                    break
                at = best[1]
                if len(parts) == 2:
                    pair = (self.ranks[parts[0]], self.ranks[parts[1]])
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = self._halves[token] = pair
        return found

    def agree(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding.

        Walks through the life of the two parts that touch at the seam while both
        tokens are being merged. If they could merge with each other before either
        is merged inwards, the encoding of the joined bytes would differ.
        """
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is not None:
            return found
        ends, heads = self._lives(left, 1), self._lives(right, 0)
        i, j = len(ends) - 1, len(heads) - 1
        rank_of, verdict = self.ranks.get, True
        while True:
            x, x_until = ends[i]
            y, y_until = heads[j]
            merge = rank_of(x + y)
            if merge is not None and merge < x_until and merge <= y_until:
                verdict = False
                break
            if x_until <= y_until:
                if not i:
                    break
                i -= 1
            else:
                j -= 1
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        self._pairs[key] = verdict
        return verdict

    def _lives(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts at one end of a token while it is merged, the token first, each with the rank that ends it."""
        found = self._parts[side].get(token)
        if found is None:
            found, until = [(self.bytes_of[token], 1 << 60)], token
            while pair := self.halves(until):
                found.append((self.bytes_of[pair[side]], until))
                until = pair[side]
            self._parts[side][token] = found
        return found

    def _shape_step(self, key: int) -> tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]:
        """What a byte does to a shape: the shape after (times 256), which beginnings stay, and the tokens that may end.

        Beginnings are told by their place in a state; a token that may end comes with that of its beginning.
        """
        byte = key & 255
        nodes, kept, ends = [], [], []
        for at, node in enumerate(self._shapes[key >> 8], 1):
            child, token = self._edges.get(node | byte, (-1, -1))
            if token >= 0:
                ends.append((at, token))
            if child >= 0:
                nodes.append(child)
                kept.append(at)
        nodes = (*nodes, 0)
        shape = self._shape_of.get(nodes)
        if shape is None:
            shape = self._shape_of[nodes] = len(self._shapes)
            self._shapes.append(nodes)
        found = self._shape_steps[key] = (shape << 8, tuple(kept), tuple(ends))
        return found

    def _make(self, number: int, byte: int) -> int:
        """The state after ``byte``; states count 256 each."""
        state = self._states[number >> 8]
        shape, kept, ends = self._shape_steps.get(state[0] | byte) or self._shape_step(state[0] | byte)
        for at, token in ends:
            before = state[at]
            if before < 0:
                break
            fits = self._pairs.get(before << 32 | token)
            if fits or fits is None and self.agree(before, token):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}: the ranks lack single bytes")
        moved = (shape, *[state[at] for at in kept], token)
        after = self._number.get(moved)
        if after is None:
            after = self._number[moved] = len(self._states) << 8
            self._states.append(moved)
        self._steps[number | byte] = after
        return after

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._steps) > MOST_STEPS or len(self._shape_steps) > MOST_STEPS:
            self._reset()
        step, number, taken = self._steps.get, 0, []
        for byte in piece:
            after = step(number | byte)
            if after is None:
                after = self._make(number, byte)
            taken.append(after)
            number = after
        states, size, out, at = self._states, self._size, [], len(piece) - 1
        while at >= 0:
            token = states[taken[at] >> 8][-1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class Utf8Machine:
    """States: 0 between code points; else what the next byte may be and how many follow; -1 after a fault."""

    # Lead byte ranges with the range of the next byte and the number of further bytes.
    LEADS = [(0x00, 0x7F, None, 0), (0xC2, 0xDF, (0x80, 0xBF), 0), (0xE0, 0xE0, (0xA0, 0xBF), 1),
             (0xE1, 0xEC, (0x80, 0xBF), 1), (0xED, 0xED, (0x80, 0x9F), 1), (0xEE, 0xEF, (0x80, 0xBF), 1),
             (0xF0, 0xF0, (0x90, 0xBF), 2), (0xF1, 0xF3, (0x80, 0xBF), 2), (0xF4, 0xF4, (0x80, 0x8F), 2)]

    def __init__(self):
        self.lead = {b: ((*span, more) if span else 0)
                     for low, high, span, more in self.LEADS for b in range(low, high + 1)}

    def step(self, state, byte: int):
        if state == 0:
            return self.lead.get(byte, -1)
        if state == -1 or not state[0] <= byte <= state[1]:
            return -1
        return (0x80, 0xBF, state[2] - 1) if state[2] else 0

    def run(self, state, data: bytes):
        for byte in data:
            state = self.step(state, byte)
        return state


class StreamDecoder:
    """Text of ids as they come; bytes that cannot be UTF-8 become U+FFFD.

    Tokens that begin and end between code points leave the machine at rest, so a run of
    them that meets it at rest is copied in one piece; all others go through it byte by byte.
    """

    def __init__(self, pieces: dict[int, bytes] | list[bytes], whole: np.ndarray | None = None,
                 table: Strings | None = None, machine: Utf8Machine | None = None):
        self.pieces, self.machine = pieces, machine or Utf8Machine()
        self.whole, self.table = whole, table
        self.state, self.held, self.faults = 0, bytearray(), 0

    def feed(self, ids) -> str:
        if self.table is None:
            return "".join([self._bytes(self.pieces[int(token)]) for token in ids])
        numbers = np.asarray(ids, np.int64)
        resting = self.whole[numbers]
        if self.state == 0 and resting.all():
            return self.table.gather(numbers)[0].tobytes().decode()
        out, at = [], 0
        turns = np.append(np.flatnonzero(np.diff(resting)) + 1, len(numbers)).tolist() if len(numbers) else []
        for end in turns:
            begin = at
            if resting[at]:
                while begin < end and self.state != 0:  # what is unfinished breaks off first
                    out.append(self._bytes(self.pieces[numbers[begin]]))
                    begin += 1
                out.append(self.table.gather(numbers[begin:end])[0].tobytes().decode())
            else:
                out += [self._bytes(self.pieces[token]) for token in numbers[begin:end].tolist()]
            at = end
        return "".join(out)

    def _bytes(self, piece: bytes) -> str:
        out = []
        for byte in piece:
            after = self.machine.step(self.state, byte)
            if after == -1 and self.held:  # what was begun is broken off; the byte may begin anew
                out.append("\ufffd")
                self.faults += 1
                self.held.clear()
                after = self.machine.step(0, byte)
            if after == -1:
                out.append("\ufffd")
                self.faults += 1
                self.state = 0
                continue
            self.held.append(byte)
            self.state = after
            if after == 0:
                out.append(self.held.decode())
                self.held.clear()
        return "".join(out)

    def close(self) -> str:
        rest, self.state = ("\ufffd" if self.held else ""), 0
        self.faults += len(rest)
        self.held.clear()
        return rest


def _words(text: str) -> list[str]:
    """Parts of a text between spaces, but for spaces that have other white space, or an end of the text, beside them."""
    parts = text.split(" ")
    if not BESIDE_SPACE.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        before = out[-1]
        if before and part and not before[-1].isspace() and not part[0].isspace():
            out.append(part)
        else:
            out[-1] = f"{before} {part}"
    return out


def _little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    """A vocabulary file with its piece pattern: encodes texts to little-endian ids and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.transducer = Transducer(ranks)
        self.pieces_of = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        machine = Utf8Machine()
        most = max(ranks.values()) + 1
        self.pieces = [b""] * most
        self.whole = np.zeros(most, bool)  # tokens that begin and end between code points
        for token, rank in ranks.items():
            self.pieces[rank] = token
            self.whole[rank] = machine.run(0, token) == 0
        self.machine = machine
        self.table = Strings(self.pieces)

    def _piece(self, piece: str) -> bytes:
        found = self._known.get(piece)
        if found is None:
            data = piece.encode()
            found = _little(self.transducer.encode(data))
            if len(data) <= CACHED_BYTES:
                if len(self._known) >= PIECE_CACHE:
                    self._known.clear()
                self._known[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        ids = b"".join([self._piece(p) for p in self.pieces_of(word)])
        if len(word) <= CACHED_BYTES:
            if len(self._words) >= PIECE_CACHE:
                self._words.clear()
            self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A piece holds a single space only at its front, so a text can be cut before
        every space that has no white space beside it: words are looked up whole.
        """
        known, make = self._words.get, self._word
        parts = _words(text)
        out = [known(parts[0]) or make(parts[0])]
        out += [known(p) or make(p) for p in [" " + p for p in parts[1:]]]
        return b"".join(out)

    def decoder(self) -> StreamDecoder:
        return StreamDecoder(self.pieces, self.whole, self.table, self.machine)

    def decode(self, ids: bytes) -> tuple[bytes, bool]:
        """UTF-8 of the ids through the streaming decoder, and whether their bytes were UTF-8 as they are."""
        stream = self.decoder()
        text = stream.feed(np.frombuffer(ids, "<u4")) + stream.close()
        return text.encode(), stream.faults == 0


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids), ids being little-endian unsigned 32-bit integers; a null text encodes to no ids.

    ``path`` must be readable on every executor. Rows are treated one by one, so
    null and repeated ids change nothing.
    """
    def build(batch: pa.RecordBatch) -> dict:
        coder = codec(path, pattern)
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"),
                "ids": pa.array([coder.encode(t) for t in batch.column("text").to_pylist()], pa.binary())}

    return by_batch(texts(df, id_col, text_col), build, "doc_id long, text string, ids binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_utf8) of every text, in one pass."""
    def build(batch: pa.RecordBatch) -> dict:
        coder = codec(path, pattern)
        rows = []
        for text in batch.column("text").to_pylist():
            ids = coder.encode(text)
            data, valid = coder.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), valid))
        counts, ids, decoded, valid = zip(*rows)
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded), "decoded_utf8": pa.array(valid)}

    return by_batch(texts(df, id_col, text_col), build,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_utf8 boolean")
