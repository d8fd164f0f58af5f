"""Corpus operators on texts, against brute force and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskrank.llm import byte_bpe, line_dedup, near_dup, packing, quality, queries, secrets, sharding, toxicity
from riskrank.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, "
          "score double, length int, start int, size string, shard string, kind string")
LONG = "lorem ipsum dolor " * 3000


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like results."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None),
            (3, "", "xx", "s", 0), (4, LONG, "en", "s", len(LONG)), (5, LONG, "fr", None, 1),
            (None, "a b c d e f", "en", "s", 1), (None, None, "en", "s", 1), (6, " \n\t ", "en", "s", 1),
            (7, "é😀 password=hunter22 x\nline\nline", "en", "s", 1)]
    return spark.createDataFrame([(*r, False, 9, 0.5, 1, 1, "x", "y", "z") for r in rows], SCHEMA)


def collected(df):
    return {tuple(r) for r in df.collect()}


def test_secret_spans_against_patterns(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                        r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = 0
    for doc in docs.select("doc_id", "text").collect():
        text, spans = doc.text or "", []
        spans += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        row = got[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        found += len(spans)
    assert found > 0


def test_window_entropy_and_allow_list(spark):
    runs = ["Zk8qP2mV9sLw4TbN7yRc3Hd6Jf", "abcABC123abcABC123abcABC123", "A1" * 15]
    alphabet = secrets.CLASSES[2][2]
    got = spark.createDataFrame([(r,) for r in runs], "r string").select(
        "r", secrets.window_entropy(F.col("r"), alphabet).alias("e")).collect()
    for r in got:
        width = secrets.WINDOW
        best = max(-sum(c / width * math.log2(c / width) for c in Counter(r.r[i:i + width]).values())
                   for i in range(len(r.r) - width + 1))
        assert r.e == pytest.approx(best)
    texts = spark.createDataFrame([(1, "key Zk8qP2mV9sLw4TbN7yRc3Hd6Jf."), (2, "see internationalizationalization"),
                                   (3, "id 123E4567-e89b-12d3-a456-426614174000"), (4, None),
                                   (5, "EXAMPLEZk8qP2mV9sLw4TbN7yRc")], "doc_id long, text string")
    spans = {r.doc_id: r.s for r in secrets.scan_secrets(texts).select(
        "doc_id", secrets.written(F.col("secret_spans")).alias("s")).collect()}
    assert spans == {1: "entropy:4:30", 2: "", 3: "", 4: "", 5: ""}


def test_redaction_masks_overlapping_spans_once(spark, awkward):
    texts = spark.createDataFrame([(1, "x token='0123456789abcdef01234567' y"), (2, "password=abcdef"), (3, None),
                                   (4, "clean")], "doc_id long, text string")
    assert collected(secrets.redact(texts)) == {(1, "x [SECRET]' y"), (2, "[SECRET]"), (3, None), (4, "clean")}
    masked = secrets.redact(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()


def brute_components(texts, words):
    sets = {}
    for key, text in texts.items():
        found = (text or "").encode().lower().split()
        width = min(words, len(found))
        sets[key] = {tuple(found[i:i + width]) for i in range(len(found) - width + 1)} if found else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    docs = table(spark, FOLDER, "documents")
    got = near_dup.link_documents(docs, near_dup.NearDup(words=words)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(
        {r.doc_id: r.text for r in docs.collect()}, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_cloud_at_the_threshold_keeps_its_components(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(150):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dup.link_documents(docs, near_dup.NearDup(words=1))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 1)


def test_near_duplicates_on_awkward_rows(spark, awkward):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.link_documents(awkward).collect())
    assert got == {(1, 1, True): 2, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 4, False): 1,
                   (None, 1, False): 1, (None, None, False): 1, (6, 6, True): 1, (7, 7, True): 1}
    assert near_dup.keep_one(awkward).count() == awkward.count() - 1
    assert near_dup.link_documents(awkward.limit(0)).count() == 0


def test_fast_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
    for shared, own in ((1, 0), (80, 20), (500, 0), (300, 300)):
        a, b = pool[:shared + own], np.concatenate([pool[:shared], pool[-own:] if own else pool[:0]])
        values = np.concatenate([a, b])
        sketch = near_dup.fast_sketch(values, np.repeat([0, 1], [len(a), len(b)]), 2, 200)
        assert (sketch != np.iinfo(np.uint64).max).all()
        assert abs((sketch[0] == sketch[1]).mean() - shared / (shared + 2 * own)) < 0.12


def test_quality_counts_against_brute_force(spark, awkward):
    docs = table(spark, FOLDER, "documents")
    refs = quality.fit_references(docs)
    got = {r.doc_id: r for r in quality.judge_documents(docs, refs).collect()}
    for doc in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text)
        lines = [x for x in doc.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        row = got[doc.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", doc.text)),
            len(lines) - len(set(lines)), len(inside))
        assert row.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    judged = [(labels[k], r.kept) for k, r in got.items() if k in labels and not r.base_failed]
    assert np.mean([kept for good, kept in judged if good == 1]) > 0.97
    odd = quality.judge_documents(awkward, refs).collect()
    assert len(odd) == awkward.count() and all(not r.kept for r in odd if not r.n_words)
    assert quality.judge_documents(awkward, quality.fit_references(awkward.limit(0))).count() == awkward.count()


def test_js_distance_bounds():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 4]), np.array([1, 2.0])) == pytest.approx(0)


def test_byte_bpe_equals_the_library(spark, awkward):
    codec = byte_bpe.codec(queries.BYTE_VOCABULARY, public_tokenizers.PATTERN)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks,
                              special_tokens={})
    texts = [r.text for r in table(spark, FOLDER, "documents").collect()]
    texts += ["a" * 3000, " " * 500 + "x", "the" * 700, "é漢字😀ßü \n\n x  y", "  x y\t\tz ", "", " ", "\x1c a"]
    for text in texts:
        ids = codec.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == exact.encode_ordinary(text)
        assert codec.decode(ids) == (text.encode(), True)
    stream = byte_bpe.StreamDecoder(codec.transducer.bytes_of)
    ids = exact.encode_ordinary("é漢字😀ßü x")
    assert "".join(stream.feed([i]) for i in ids) + stream.close() == "é漢字😀ßü x"
    rows = byte_bpe.round_trip(awkward, queries.BYTE_VOCABULARY, public_tokenizers.PATTERN).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))


def test_toxicity_learns_from_its_own_rows_only(spark, awkward):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, flipped) == model
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held_out", toxicity.held_out())
    rows = [r for r in scored.collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.5 and not any(r.predicted for r in rows if not r.toxic)
    odd = toxicity.score_toxicity(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    empty = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, empty).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.drop_toxic(awkward, labels).columns == awkward.columns


def test_noisy_or_finds_the_word_behind_the_labels():
    counts = np.array([3, 3, 3, 3])
    weights, intercept = toxicity.fit_bags(
        counts, np.array([0, 3, 7, 10]), np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0]), 2, toxicity.Fit(support=0.01))
    assert weights[0] > 3 > weights[1] and intercept < 0


def test_hilbert_steps_touch(spark):
    cube = spark.range(512).select((F.col("id") % 8).cast("int").alias("x"),
                                   (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"),
                                   F.floor(F.col("id") / 64).cast("int").alias("z"))
    path = sorted((r.h, r.x, r.y, r.z) for r in cube.withColumn(
        "h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).collect())
    assert [p[0] for p in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("slice_rows", [1_000_000, 7])
def test_shards_are_even_runs_of_the_curve(spark, awkward, slice_rows):
    how = sharding.Sharding(slice_rows=slice_rows)
    docs = table(spark, FOLDER, "documents")
    rows = sharding.shard_documents(docs, how).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows)
    odd = sharding.shard_documents(awkward, how).collect()
    assert len(odd) == awkward.count() and len({(r.shard, r.slot) for r in odd}) == len(odd)
    assert sharding.shard_documents(awkward.limit(0), how).count() == 0


def test_boilerplate_by_site(spark, awkward):
    rows = [(i, f"own {i}\n  menu \nbody", "host") for i in range(4)] + [(9, "menu\nother", "else"), (10, None, "host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n) for r in line_dedup.drop_boilerplate(docs, removed_col="n").collect()}
    assert got == {**{i: (f"own {i}", 2) for i in range(4)}, 9: ("menu\nother", 0), 10: (None, 0)}
    cleaned = line_dedup.drop_boilerplate(awkward)
    assert sorted(cleaned.columns) == sorted(awkward.columns) and cleaned.count() == awkward.count()


def test_packing_against_exhaustive_search(spark):
    def fewest(items, limit):
        best, items = [len(items)], sorted(items, reverse=True)

        def place(at, bins):
            if len(bins) >= best[0]:
                return
            if at == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[at] <= limit:
                    place(at + 1, bins[:k] + [bins[k] + items[at]] + bins[k + 1:])
            place(at + 1, bins + [items[at]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(5)
    for _ in range(60):
        items = rng.integers(1, 100, rng.integers(1, 10)).tolist()
        plan = packing.complete_bins(Counter(items), packing.Packing(limit=100))
        assert Counter(s for pieces, n in plan for s in pieces for _ in range(n)) == Counter(items)
        assert all(sum(pieces) <= 100 for pieces, _ in plan)
        assert sum(n for _, n in plan) == fewest(items, 100)
    assert packing.complete_bins({}) == []


@pytest.mark.parametrize("slice_rows", [1_000_000, 3])
def test_packed_sequences_are_gapless_and_hold_the_library_ids(spark, awkward, slice_rows):
    how = packing.Packing(slice_rows=slice_rows)
    exact = Tokenizer.from_file(queries.WORD_VOCABULARY)
    exact.encode_special_tokens = True
    for docs in (table(spark, FOLDER, "documents"), awkward):
        rows = packing.pack_documents(docs, queries.WORD_VOCABULARY, how, with_ids=True).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        whole = {}
        for r in sorted(rows, key=lambda r: r.piece):
            whole.setdefault(r.doc_id, []).append(list(np.frombuffer(r.ids, "<u4")))
        for doc in docs.collect():
            ids = exact.encode(doc.text or "", add_special_tokens=False).ids + [0]
            if doc.doc_id not in (1, None):  # these ids are repeated in the awkward rows
                assert sum(whole[doc.doc_id], []) == ids
    assert packing.pack_documents(awkward.limit(0), queries.WORD_VOCABULARY, how).count() == 0


def test_cloud_of_edited_copies_keeps_every_link(spark):
    """Copies of one text with up to a quarter of its words changed: similarities lie on both sides of 0.8."""
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    docs = [(0, " ".join(base[:150] + [f"z{i}" for i in range(14)]))]
    for doc in range(1, 260):
        words = list(base)
        for at in draw.choice(160, int(draw.integers(1, 22)), replace=False):
            words[at] = f"x{draw.integers(10 ** 9)}"
        docs.append((doc, " ".join(words)))
    sets = {doc: set(zip(text.split(), text.split()[1:])) for doc, text in docs}
    root = {doc: doc for doc in sets}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for one in sets:
        for two in range(one):
            if 100 * len(sets[one] & sets[two]) >= 80 * len(sets[one] | sets[two]):
                low, high = sorted((find(one), find(two)))
                root[high] = low
    want = {(doc, find(doc)) for doc in sets}
    assert 3 < len({component for _, component in want}) < 200
    got = near_dup.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), near_dup.NearDup(words=2))
    assert collected(got.select("doc_id", "component_id")) == want
