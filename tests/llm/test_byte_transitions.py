"""What the transducer need not work out again."""

import random

import public_tokenizers

from riskrank.llm import byte_bpe, queries


def test_transitions_are_shared_by_prefixes_that_go_on_alike():
    coder = byte_bpe.Codec(queries.BYTE_VOCABULARY, public_tokenizers.PATTERN).transducer
    made, make = [], coder._make
    coder._make = lambda number, byte: made.append(byte) or make(number, byte)
    draw = random.Random(7)
    parts = ["th", "in", "er", "ou", "tion", "an", "re", "st"]
    words = {" " + "".join(draw.choices(parts, k=8)) for _ in range(3_000)}
    for word in words:
        assert b"".join(coder.bytes_of[t] for t in coder.encode(word.encode())) == word.encode()
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)}
    assert len(made) < len(prefixes) / 3
