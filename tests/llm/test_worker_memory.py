"""What workers of the toxicity stage hold at once."""

import gc
import os
import tracemalloc
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from riskrank.llm import common, near_dup, packing, toxicity


def test_toxic_ids_are_written_before_the_rows_meet_them(spark):
    rows = [(i, f"{'vile scum' if i % 4 == 0 else 'fine day'} number {i}. And more of it {i * i}.", "en", "x", 9)
            for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "vile scum.", "en", "x", 9), (4, "fine day again.", "en", "x", 9)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels, toxicity.Fit(evidence=5.0))
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    found = [r.doc_id for r in kept.collect()]
    # A toxic text drops all rows of its id; rows without id stay.
    assert None in found and 4 not in found and len(found) == 301


def test_workers_take_few_rows_at_once(spark):
    def build(batch):
        return {"id": batch.column("id"), "rows": [batch.num_rows] * batch.num_rows}

    made = common.by_batch(spark.range(0, 2_501, 1, 1), build, "id long, rows long", 1_000).collect()
    assert [r.id for r in made] == list(range(2_501))
    assert sorted({r.rows for r in made}) == [501, 1_000]


def test_traits_of_many_texts_are_counted_without_holding_them_all():
    how = toxicity.Fit(places=1 << 12)
    words = [f"w{i:05}" for i in range(1_000)]
    texts = [" ".join(words[i:] + words[:i // 2]) for i in range(600)]
    marks = [i % 3 % 2 for i in range(600)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array(marks, pa.int32())})
    known = toxicity._Traits(how)
    for word in words:
        known[word]
    tracemalloc.start()
    made = toxicity.count_traits(batch, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    owned = [{t for w in text.split() for t in toxicity.traits(w, how)} for text in texts]
    assert peak < 8 * sum(map(len, owned)) / 4  # one number per text and trait takes four times that
    spread, toxic = Counter(), Counter()
    for own, mark in zip(owned, marks):
        spread.update(own)
        toxic.update(own if mark else ())
    assert {t: (s, y) for t, s, y in zip(*(made[n].to_pylist() for n in ("trait", "spread", "toxic")))} == \
        {t: (s, toxic[t]) for t, s in spread.items()}


def test_words_without_weight_share_one_set():
    known = toxicity._Weights(toxicity.Model({}, -6.0), toxicity.Fit())
    assert known["fine"] is known["day"]


def test_a_worker_drops_the_vocabulary_when_tasks_of_another_operator_begin(spark):
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat('word', id, ' and more of it') AS text")
    path = public_tokenizers.path("word_bpe_49k.json")

    def coders() -> list[int]:
        return [sum(type(o).__name__ == "Coder" for o in gc.get_objects())]

    def held(batch):
        return {"n": coders() * batch.num_rows}

    def built(batch):
        packing.coder(path)
        return {"n": coders() * batch.num_rows}

    assert packing.cut_pieces(docs, path).count() == 400
    assert {r.n for r in common.by_batch(docs, built, "n long", keeps=packing._key(path)).collect()} == {1}
    assert {r.n for r in common.by_batch(docs, held, "n long").collect()} == {0}


def test_only_the_key_at_hand_is_kept(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    one = common.kept_by_worker("one", list)
    common.forget_others("one")
    assert common.kept_by_worker("one", list) is one
    common.forget_others("two")
    assert common.kept_by_worker("one", list) is not one


def test_the_tokenizer_works_on_the_task_s_own_core(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    packing.Coder(public_tokenizers.path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("operator", ["sketches", "pieces"])
def test_texts_become_objects_a_thousand_at_a_time(spark, monkeypatch, operator):
    docs = spark.range(0, 2_500, 1, 1).selectExpr("id AS doc_id", "concat('word', id, ' and more of it') AS text")
    seen, whole = [], common.by_batch
    module = near_dup if operator == "sketches" else packing

    def by_batch(df, build, schema, rows=None, *more):
        seen.append(rows)
        return whole(df, build, schema, rows, *more)

    monkeypatch.setattr(module, "by_batch", by_batch)
    made = near_dup.sketches(docs, near_dup.NearDup()) if operator == "sketches" else \
        packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert made.count() == 2_500 and seen == [1_000]


def test_sketches_are_made_of_few_shingles_at_once(monkeypatch):
    texts = [" ".join(f"w{i * 977 + j}" for j in range(600)) for i in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1_000)), "text": texts})
    known = near_dup._Words()
    tracemalloc.start()
    made = near_dup._sketch_batch(batch, near_dup.NearDup(), known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    monkeypatch.setattr(near_dup, "CHUNK_SHINGLES", 1 << 21)
    other = near_dup._sketch_batch(batch, near_dup.NearDup(), near_dup._Words())
    assert made["keys"].equals(other["keys"]) and (made["print_a"] == other["print_a"]).all()
