"""Near-duplicate vectors by small-world graphs per shard.

Vectors of a label are dealt over shards of about ``shard_rows`` by a hash of
their id. Each shard gets a hierarchical navigable small-world graph; every
vector queries every shard of its label, in blocks. A query that fills its beam
with links is repeated with a wider beam, and a block whose audited queries
(ids divisible by 50) miss more links of the shard than allowed is repeated with
a wider beam as a whole; a beam as wide as the shard is the exact search. Every
found pair is verified by its cosine in double precision. What a task returns
is a link count per query and a spanning forest of its links, not the pairs.

Exact copies are collapsed first and counted back in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.llm.common import mix
from riskrank.llm.components import components
from riskrank.session import materialise


@dataclass(frozen=True)
class VectorDup:
    least: float = 0.98
    shard_rows: int = 4096
    block_rows: int = 2048
    degree: int = 12  # links made per layer; the lowest holds twice as many
    build_beam: int = 40
    beam: int = 32
    recall: float = 0.995
    seed: int = 11


class Graph:
    """Small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors, levels, links

    @property
    def top(self) -> int:
        return len(self.links) - 1


def _search(graph: Graph, layer: int, queries: np.ndarray, enter: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), both (queries, beam) and best first, -1 where a beam is not full.

    All queries advance together: each opens its best node not opened yet, unless
    that is worse than the last of a full beam.
    """
    n, count = len(graph.vectors), len(queries)
    links = graph.links[layer]
    beam = min(beam, n)
    rows = np.arange(count)
    nodes = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf)
    done = np.ones((count, beam), bool)
    seen = np.zeros((count, n + 1), bool)  # the last place takes absent links
    seen[:, n] = True
    width = enter.shape[1]
    first = np.where(enter >= 0, enter, n)
    start = np.where(enter >= 0, np.einsum("qd,qkd->qk", queries, graph.vectors[np.minimum(first, n - 1)]), -np.inf)
    order = np.argsort(-start, axis=1, kind="stable")[:, :beam]
    take = min(width, beam)
    nodes[:, :take] = np.take_along_axis(enter, order, 1)[:, :take]
    near[:, :take] = np.take_along_axis(start, order, 1)[:, :take]
    done[:, :take] = nodes[:, :take] < 0
    seen[rows[:, None], first] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], -np.inf, near[live])
        best = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        reach = links[nodes[live, best]]
        reach = np.where(reach < 0, n, reach)
        fresh = ~seen[live[:, None], reach]
        seen[live[:, None], reach] = True
        useful = fresh.any(axis=1)
        if not useful.any():
            continue
        part, reach, fresh = live[useful], reach[useful], fresh[useful]
        # A node listed twice among one node's links would be counted twice; links are distinct.
        similar = np.full(reach.shape, -np.inf)
        at = np.nonzero(fresh)
        similar[at] = np.einsum("kd,kd->k", queries[part[at[0]]], graph.vectors[reach[at]])
        all_near = np.concatenate([near[part], similar], axis=1)
        all_nodes = np.concatenate([nodes[part], np.where(fresh, reach, -1)], axis=1)
        all_done = np.concatenate([done[part], ~fresh], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[part] = np.take_along_axis(all_near, order, 1)
        nodes[part] = np.take_along_axis(all_nodes, order, 1)
        done[part] = np.take_along_axis(all_done, order, 1)
    return nodes, near


def _choose(vectors: np.ndarray, own: np.ndarray, found: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours: first those nearer to the node than to one chosen before, then the nearest left."""
    if len(found) <= most:
        return found
    order = np.argsort(-similar, kind="stable")
    found, similar = found[order], similar[order]
    between = vectors[found] @ vectors[found].T
    chosen: list[int] = []
    closest = np.full(len(found), -np.inf)
    for at in range(len(found)):
        if similar[at] > closest[at]:
            chosen.append(at)
            if len(chosen) == most:
                break
            closest = np.maximum(closest, between[:, at])
    if len(chosen) < most:
        rest = np.setdiff1d(np.arange(len(found)), chosen)[:most - len(chosen)]
        chosen += rest.tolist()
    return found[chosen]


def build_graph(vectors: np.ndarray, ids: np.ndarray, how: VectorDup) -> Graph:
    """Insert all vectors, those of the highest layers first, in batches that search together."""
    n = len(vectors)
    draw = (mix(ids.astype(np.uint64) + np.uint64(how.seed)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(how.degree)).astype(np.int64), 8)
    order = np.lexsort((ids, -levels))
    vectors, levels = vectors[order], levels[order]
    top = int(levels[0]) if n else 0
    caps = [how.degree * (2 if layer == 0 else 1) for layer in range(top + 1)]
    room = [2 * cap for cap in caps]  # lists are cut back to their cap only when this is full
    links = [np.full((n if layer == 0 else int((levels >= layer).sum()), room[layer]), -1, np.int32)
             for layer in range(top + 1)]
    degree = [np.zeros(len(part), np.int64) for part in links]
    graph = Graph(vectors, levels, links)
    at = 1
    while at < n:
        upto = min(n, at + min(64, max(1, at // 2)))
        upto = at + int((levels[at:upto] == levels[at]).sum())
        batch = np.arange(at, upto)
        level = int(levels[at])
        enter = np.zeros((len(batch), 1), np.int64)
        queries = vectors[batch]
        for layer in range(top, level, -1):
            enter = _search(graph, layer, queries, enter, 1)[0]
        among = queries @ queries.T
        for layer in range(level, -1, -1):
            nodes, near = _search(graph, layer, queries, enter, how.build_beam)
            enter = nodes
            for row, node in enumerate(batch):
                known = nodes[row] >= 0
                found = np.concatenate([nodes[row][known], batch[:row]])
                similar = np.concatenate([near[row][known], among[row, :row]])
                chosen = _choose(vectors, node, found, similar, how.degree)
                links[layer][node, :len(chosen)] = chosen
                degree[layer][node] = len(chosen)
                for other in chosen:
                    if degree[layer][other] == room[layer]:
                        full = links[layer][other]
                        kept = _choose(vectors, other, full, vectors[full] @ vectors[other], caps[layer])
                        links[layer][other] = -1
                        links[layer][other, :len(kept)] = kept
                        degree[layer][other] = len(kept)
                    links[layer][other, degree[layer][other]] = node
                    degree[layer][other] += 1
        at = upto
    graph.order = order
    return graph


def linked(graph: Graph, queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of pairs at or above ``least``; queries whose beam fills up with links get a wider one, in the end the whole shard."""
    n = len(graph.vectors)
    slack = least - 1e-9
    pairs = []
    waiting = np.arange(len(queries))
    while len(waiting):
        if 2 * beam >= n:
            pairs += [(waiting[q], k) for q, k in (np.nonzero(queries[waiting] @ graph.vectors.T >= slack),)]
            break
        full = []
        for at in range(0, len(waiting), 256):
            part = waiting[at:at + 256]
            enter = np.zeros((len(part), 1), np.int64)
            for layer in range(graph.top, 0, -1):
                enter = _search(graph, layer, queries[part], enter, 4)[0]
            nodes, near = _search(graph, 0, queries[part], enter, beam)
            over = near[:, -1] >= slack
            hit = (near >= slack) & ~over[:, None]
            row, column = np.nonzero(hit)
            pairs.append((part[row], nodes[row, column]))
            full.append(part[over])
        waiting = np.concatenate(full)
        beam *= 8
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def audited(graph: Graph, queries: np.ndarray, audit: np.ndarray, how: VectorDup) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of all queries with a beam at which the audited ones miss few enough: (query, node, beam)."""
    beam = how.beam
    true = int((queries[audit] @ graph.vectors.T >= how.least - 1e-9).sum()) if len(audit) else 0
    while True:
        if true and beam < len(graph.vectors):
            got = len(linked(graph, queries[audit], beam, how.least)[0])
            if got < how.recall * true:
                beam *= 2
                continue
        query, node = linked(graph, queries, beam, how.least)
        return query, node, beam


def _unit(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    norms = np.sqrt((raw * raw).sum(axis=1))
    return raw, norms


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the given links that are not roots themselves."""
    ids, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[:len(left)], places[len(left):]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def link_vectors(df: DataFrame, how: VectorDup = VectorDup()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row of (vec_id, embedding, label).

    Vectors link only under equal labels. Null labels and vectors that are null,
    zero or hold null or non-finite components link with nothing, and so do vectors
    with a null id, whose component is null and which are not kept. Vectors of
    unequal length are not compared. Rows that repeat an id count as vectors of their
    own for n_links and share a component. An empty table gives no rows.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding"))
    good = rows.where(F.coalesce(usable, F.lit(False))).withColumns({
        "width": F.size("embedding"), "embedding": F.transform(double, lambda x: x + F.lit(0.0))})
    group = ["label", "width"]
    held = materialise(good.groupBy(*group, "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    sizes = held.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *group, F.ceil(F.col("n") / how.shard_rows).cast("int").alias("shards"),
        F.ceil(F.col("n") / how.block_rows).cast("int").alias("blocks"))
    sized = held.join(sizes, group)
    place = F.pmod(F.xxhash64("rep", F.lit(how.seed)), F.col("shards")).cast("int")

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rep"], kind="stable").reset_index(drop=True)
        raw, norms = _unit(frame)
        graph = build_graph(raw / norms[:, None], frame["rep"].to_numpy(), how)
        order = graph.order
        packed = [raw[order].tobytes(), frame["rep"].to_numpy(np.int64)[order].tobytes(),
                  frame["copies"].to_numpy(np.int64)[order].tobytes(), graph.levels.tobytes(),
                  *[part.tobytes() for part in graph.links]]
        return pd.DataFrame({"label": [frame["label"].iloc[0]], "width": [frame["width"].iloc[0]],
                             "shard": [frame["shard"].iloc[0]], "n": [len(frame)], "graph": [packed]})

    label = df.schema["label"].dataType.simpleString()
    graphs = materialise(sized.withColumn("shard", place).groupBy(*group, "shard").applyInPandas(
        index, f"label {label}, width int, shard int, n long, graph array<binary>"), "graphs")

    # Every block of queries with every shard of its label.
    block = F.pmod(F.xxhash64("rep", F.lit(how.seed + 1)), F.col("blocks")).cast("int")
    queries = sized.withColumn("block", block) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    targets = graphs.join(sizes, group).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    key = [*group, "shard", "block"]

    def search(frame: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"vec_id": np.empty(0, np.int64), "links": np.empty(0, np.int64),
                              "a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if not len(frame) or not len(shard):
            return empty
        n, width, packed = int(shard["n"].iloc[0]), int(shard["width"].iloc[0]), shard["graph"].iloc[0]
        raw = np.frombuffer(packed[0]).reshape(n, width)
        ids, copies, levels = (np.frombuffer(p, np.int64) for p in packed[1:4])
        norms = np.sqrt((raw * raw).sum(axis=1))
        links = [np.frombuffer(p, np.int32) for p in packed[4:]]
        caps = [4 * how.degree if layer == 0 else 2 * how.degree for layer in range(len(links))]
        graph = Graph(raw / norms[:, None], levels, [p.reshape(-1, c) for p, c in zip(links, caps)])
        frame = frame.sort_values("rep", kind="stable")
        own, own_norms = _unit(frame)
        reps = frame["rep"].to_numpy(np.int64)
        query, node, _ = audited(graph, own / own_norms[:, None], np.flatnonzero(reps % 50 == 0), how)
        exact = np.einsum("kd,kd->k", own[query], raw[node]) / (own_norms[query] * norms[node])
        keep = (exact >= how.least) & (reps[query] != ids[node])
        query, node = query[keep], node[keep]
        counts = np.bincount(query, copies[node], len(reps)).astype(np.int64)
        moved, roots = _forest(reps[query], ids[node])
        some = counts > 0
        return pd.concat([
            pd.DataFrame({"vec_id": reps[some], "links": counts[some], "a": -1, "b": -1}),
            pd.DataFrame({"vec_id": -1, "links": 0, "a": moved, "b": roots})]).astype("int64")

    found = materialise(queries.select(*key, "rep", "embedding").groupBy(*key).cogroup(
        targets.groupBy(*key)).applyInPandas(search, "vec_id long, links long, a long, b long"), "found")
    labels = components(found.where("links = 0").select("a", "b"))
    counts = found.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("others"))
    classes = (held.select(*group, "embedding", "rep", "copies")
               .join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
               .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
               .select(*group, "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    joined = good.select("vec_id", *group, "embedding").join(classes, [*group, "embedding"]) \
        .select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
