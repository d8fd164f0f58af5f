"""SentencePiece encoding by merge rounds, against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskrank.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(PATH)


def same(model, library, texts):
    for text, made, ids in zip(texts, model.encode_batch(texts), library.encode(texts, num_threads=1)):
        own = np.frombuffer(made, "<i4")
        assert own.tolist() == ids, repr(text[:200])
        assert model.decode(own).decode() == library.decode(ids), repr(text[:200])


def test_texts_of_all_kinds(model, library):
    chance = random.Random(1)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "e", "t", "in", "the", " the", "ab", "aa", "é", "İ", "中", "🙂", "\x00",
             "12", "--", "...", "ﬁ", "́", "ا", " и", "ст", "\xa0", "====", "//", "한", "<0x41>", "<s>", "<unk>"]
    texts = ["".join(chance.choices(parts, k=chance.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(chr(chance.choice([chance.randint(1, 0xD7FF), chance.randint(0xE000, 0x10FFFF),
                                         chance.randint(32, 700)])) for _ in range(20)) for _ in range(2000)]
    same(model, library, texts)


def test_runs_repeats_and_words_without_a_break(model, library):
    chance = random.Random(2)
    same(model, library, [mark * n for n in range(70) for mark in (" ", "a", "-", "ab", "=", "▁ ")])
    same(model, library, [f"x{' ' * n}{after}" for n in range(60) for after in ("y", "ﬁ", "▁", "\n", "")])
    same(model, library, ["".join(chance.choices("abdeinorst", k=chance.randint(1, 300))) for _ in range(2000)])
    same(model, library, [" " * 100_000, "the " * 30_000, "ab" * 50_000, "".join(chance.choices("aeinst", k=50_000))])


def test_words_are_remembered_within_a_bound(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KNOWN_WORDS", 10)
    same(model, library, ["some words of a text"])
    same(model, library, [" ".join(f"w{i}" for i in range(50)), "x" * 500])
    same(model, library, ["other words " + "x" * 500])
    assert all(len(word) <= piece_bpe.KNOWN_LETTERS for word in model._known)


def test_a_pair_that_ranks_better_comes_before_the_next_occurrence(model):
    """Against one merge after the other, on made-up ranks in which a long piece beats its parts."""
    def naive(word, rank):
        parts = list(word)
        while True:
            best = min(((rank[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank),
                       default=None)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    chance = random.Random(3)
    for _ in range(300):
        made = piece_bpe.PieceModel.__new__(piece_bpe.PieceModel)
        names = list({"".join(chance.choices("abc", k=chance.randint(2, 4))) for _ in range(12)})
        rank = {n: chance.randint(0, 8) for n in names}  # with ties
        pieces = ["a", "b", "c"] + names
        number = {p: i for i, p in enumerate(pieces)}
        made.size, made.span = len(pieces), len(pieces) + 0x110000
        made.symbol_of = np.arange(made.size, made.span)
        made.symbol_of[[97, 98, 99]] = [0, 1, 2]
        pairs = sorted((number[p[:c]] * made.span + number[p[c:]], number[p], rank[p])
                       for p in names for c in range(1, len(p)) if p[:c] in number and p[c:] in number)
        made.keys, made.made, made.made_rank = (np.array([p[i] for p in pairs], np.int64) for i in range(3))
        made.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in names for a, b in zip(p, p[1:])}))
        words = ["".join(chance.choices("abc", k=chance.randint(1, 14))) for _ in range(20)]
        if len(pairs):
            symbols, bounds = made.merge(words)
            got = [[pieces[i] for i in symbols[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
            assert got == [naive(w, rank) for w in words]


def test_bytes_that_are_no_text(model, library):
    for ids in ([28705, 3 + 0xC3], [28705, 3 + 0xE4, 3 + 0xB8, 28717], [3 + 0xFF, 3 + 0x41, 3 + 0xC3, 3 + 0xA9],
                [264, 3 + 0xF0, 3 + 0x9F, 3 + 0x99, 3 + 0x82, 264], []):
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_query_over_whole_table(spark, library):
    rows = {r.doc_id: r for r in queries.op11_piece_bpe(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "")
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_awkward_rows(spark):
    schema = "doc_id long, text string, ids string, n_tokens string, ids_sha256 int"
    rows = [(1, None), (1, ""), (None, "x y"), (2, "word " * 50_000), (2, "word " * 50_000), (3, " \n\t ")]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], schema)
    made = piece_bpe.round_trip(df, PATH)
    counts = sorted((r.doc_id or -1, r.n_tokens) for r in made.collect())
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(counts) == 6 and counts[0] == (-1, 2) and counts[1] == counts[2] == (1, 0) and counts[3] == counts[4]
    assert piece_bpe.round_trip(df.limit(0), PATH).count() == 0
    encoded = piece_bpe.encode_pieces(df, PATH)
    assert encoded.where("text = ''").select(F.max(F.length("ids"))).first()[0] == 0
