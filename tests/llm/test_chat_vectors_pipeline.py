"""Conversations, vectors, components and the pipeline."""

import numpy as np
import pytest
from compare import connect, difference

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from riskrank.llm import chat, vector_dup
from riskrank.llm.common import table
from riskrank.llm.components import components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op7_boilerplate_lines", "op8_chat_format"])
def test_sql_twins(spark, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(oracle_sql()[name]).df()) is None


def test_snapshots_give_way_to_what_continues_them(spark):
    def turns(conv, *said):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", s, "extra") for i, s in enumerate(said)]

    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + \
        turns(5, None) + [(None, 0, "user", "lost", "extra"), (6, None, None, "<|end|>", "extra")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.maximal_conversations(df).collect()}
    assert sorted(got) == [2, 4, 5, 6]
    assert got[2].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert got[6].rendered == "<||>\n< |end|>\n<|end|>\n" and got[6].n_turns == 1
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 7), (7, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    good = {}
    for key, vector, label in rows:
        if label is not None and vector is not None and all(x is not None for x in vector):
            v = np.array(vector, float)
            if np.isfinite(v).all() and v.any():
                good[key] = (v / np.sqrt(v @ v), label)
    linked = {k: [j for j in good if j != k and good[j][1] == good[k][1] and len(good[j][0]) == len(good[k][0])
                  and good[k][0] @ good[j][0] >= 0.98] for k in good}
    out = {}
    for key, *_ in rows:
        seen, wait = {key}, [key]
        while wait:
            for j in linked.get(wait.pop(), []):
                if j not in seen:
                    seen.add(j)
                    wait.append(j)
        out[key] = (len(linked.get(key, [])), min(seen))
    return out


@pytest.mark.parametrize("how", [vector_dup.VectorDup(), vector_dup.VectorDup(shard_rows=60, block_rows=40)])
def test_vector_links_against_all_pairs(spark, how):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    rows += [(10_000 + k, (centre + rng.normal(scale=0.1, size=64)).tolist(), 3) for k in range(300)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, [None] * 64, 1),
             (20_004, centre.tolist(), None), (20_005, centre.tolist(), 3), (20_006, centre.tolist(), 3),
             (20_007, (2 * centre).tolist(), 3), (20_008, [1.0, 2.0], 3), (20_009, [], 3)]
    df = spark.createDataFrame([(*r, True) for r in rows],
                               "vec_id long, embedding array<double>, label int, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dup.link_vectors(df, how).collect()}
    exact = brute_vectors(rows)
    assert set(got) == set(exact) and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in exact.items()}
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in exact.values())
    assert all(got[k][0] <= exact[k][0] for k in got)
    assert vector_dup.link_vectors(df.limit(0), how).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs, seen = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(seen["toxicity"]) < 1000
    assert seen["line_dedup"].keys() == seen["toxicity"].keys() and seen["line_dedup"] != seen["toxicity"]
    assert seen["near_dedup"].keys() < seen["line_dedup"].keys()
    assert seen["secrets"].keys() == seen["near_dedup"].keys()
    changed = [k for k in seen["secrets"] if seen["secrets"][k] != seen["near_dedup"][k]]
    assert changed and all("[SECRET]" in seen["secrets"][k] for k in changed)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == seen["secrets"].keys()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, FOLDER, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
