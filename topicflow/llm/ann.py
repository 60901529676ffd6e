"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Different vectors are dealt by hash to shards of about ``SHARD``; equal ones are one node that carries their smallest
ids, so a vector that a third of all rows share is one node.  A shard's graph is built in one
task, many insertions at a time, and stored as flat arrays: vectors, the nodes of each layer and a fixed
number of neighbour places per node.  Queries meet every shard in blocks, and each shard's best are merged
by exact cosines in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicflow.scratch import Scratch

SHARD = 8192
QUERIES = 1024
LINKS, LINKS0 = 16, 32
EF_BUILD, EF_SEARCH = 64, 160
BATCH = 256


@dataclass
class Layer:
    """Nodes of a layer and their neighbours (-1: none), a row for each node of the shard at layer 0."""

    nodes: np.ndarray
    links: np.ndarray


def _beam(unit: np.ndarray, links: np.ndarray, row: np.ndarray | None, queries: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: ``ef`` different nodes each (-1: none), most similar first."""
    n, b = len(unit), len(queries)
    seen = np.zeros((b, n + 1), bool)
    each = np.arange(b)[:, None]
    ids = np.full((b, ef), -1)
    sims = np.full((b, ef), -np.inf, np.float32)
    entry = np.sort(entry[:, :ef], axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    ids[:, : entry.shape[1]] = entry
    seen[each, entry] = True
    good = ids >= 0
    sims[good] = np.einsum("kd,kd->k", queries[np.nonzero(good)[0]], unit[ids[good]])
    done = ~good
    while True:
        open_ = np.where(done, -np.inf, sims)
        if np.isneginf(open_).all():
            break
        pick = np.argpartition(-open_, min(wide, ef) - 1, axis=1)[:, :wide]
        use = ~np.isneginf(np.take_along_axis(open_, pick, 1))
        np.put_along_axis(done, pick, True, 1)
        at = np.where(use, np.take_along_axis(ids, pick, 1), 0)
        found = links[at if row is None else row[at]]
        found = np.where(use[:, :, None], found, -1).reshape(b, -1)
        found = np.where(seen[each, found], -1, found)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        seen[each, found] = True
        seen[:, n] = False
        r, c = np.nonzero(found >= 0)
        near = np.full(found.shape, -np.inf, np.float32)
        near[r, c] = np.einsum("kd,kd->k", queries[r], unit[found[r, c]])
        all_sims = np.concatenate([sims, near], axis=1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims = np.take_along_axis(all_sims, top, 1)
        ids = np.take_along_axis(np.concatenate([ids, found], axis=1), top, 1)
        done = np.take_along_axis(np.concatenate([done, found < 0], axis=1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(unit: np.ndarray, base: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates: first those closer to the base than to any chosen one, then the closest."""
    out = np.full((len(base), keep), -1)
    for lo in range(0, len(base), 512):
        own, cand = base[lo : lo + 512], candidates[lo : lo + 512]
        good = (cand >= 0) & (cand != own[:, None])
        vectors = unit[np.where(good, cand, 0)]
        sims = np.where(good, np.einsum("bd,bcd->bc", unit[own], vectors), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        between = vectors @ vectors.transpose(0, 2, 1)
        nearest = np.full(sims.shape, -np.inf)
        chosen = np.zeros(sims.shape, bool)
        for k in range(sims.shape[1]):
            take = (sims[:, k] > nearest[:, k]) & (chosen.sum(axis=1) < keep)
            chosen[:, k] = take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, k]), nearest)
        rank = np.argsort(np.where(np.isneginf(sims), 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :keep]
        best = np.take_along_axis(np.where(np.isneginf(sims), -1, cand), rank, 1)
        out[lo : lo + 512, : best.shape[1]] = best
    return out


def _link_back(unit: np.ndarray, links: np.ndarray, row: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the new nodes to their neighbours' places; full rows are chosen anew."""
    r, c = np.nonzero(chosen >= 0)
    to, source = chosen[r, c], new[r]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if to.size else np.zeros(0, int)
    nth = np.arange(to.size) - np.repeat(first, np.diff(np.append(first, to.size)))
    width = links.shape[1]
    for lo in range(0, int(nth.max()) + 1 if nth.size else 0, width):
        part = (nth >= lo) & (nth < lo + width)
        nodes, at = np.unique(to[part], return_inverse=True)
        extra = np.full((nodes.size, width), -1)
        extra[at, nth[part] - lo] = source[part]
        links[row[nodes]] = _diverse(unit, nodes, np.concatenate([links[row[nodes]], extra], axis=1), width)


def build_graph(vectors: np.ndarray, seed: int = 11) -> list[Layer]:
    """Layers of the graph over the rows of ``vectors`` (all different), layer 0 first."""
    n = len(vectors)
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
    level[:1] = level.max(initial=0)  # the first node is the entry
    layers, rows = [], []
    for depth in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= depth)
        row = np.full(n, -1)
        row[nodes] = np.arange(nodes.size)
        layers.append(Layer(nodes, np.full((nodes.size, LINKS if depth else LINKS0), -1, np.int32)))
        rows.append(row)
    start = 0
    while start < n:
        stop = min(n, start + min(BATCH, max(1, start)))
        new = np.arange(start, stop)
        entry = np.zeros((new.size, 1), int)
        for depth in reversed(range(len(layers))):
            layer, row = layers[depth], rows[depth]
            joins = level[new] >= depth
            if start:
                near, _ = _beam(unit, layer.links, row, unit[new], entry, EF_BUILD if joins.any() else 8)
            else:
                near = np.full((new.size, 1), -1)
            if joins.any():
                mine = new[joins]
                mates = unit[mine] @ unit[mine].T
                np.fill_diagonal(mates, -np.inf)
                k = min(LINKS, mine.size - 1)
                closest = mine[np.argsort(-mates, axis=1, kind="stable")[:, :k]]
                chosen = _diverse(unit, mine, np.concatenate([near[joins], closest], axis=1), layer.links.shape[1] // 2)
                layer.links[row[mine], : chosen.shape[1]] = chosen
                _link_back(unit, layer.links, row, mine, chosen)
            if start:
                entry = near[:, :4]
        start = stop
    return layers


def search_graph(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """``ef`` nodes for each query (-1: none)."""
    n = len(vectors)
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    out = np.full((len(queries), ef), -1)
    for lo in range(0, len(queries), 128):
        q = queries[lo : lo + 128]
        q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        entry = np.zeros((len(q), 1), int)
        for depth in reversed(range(1, len(layers))):
            row = np.full(n, -1)
            row[layers[depth].nodes] = np.arange(layers[depth].nodes.size)
            near, _ = _beam(unit, layers[depth].links, row, q, entry, 8)
            entry = near[:, :4]
        out[lo : lo + 128] = _beam(unit, layers[0].links, None, q, entry, ef)[0]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _index(table: pa.Table) -> pa.Table:
    """One row: the shard's vectors and layers as flat arrays."""
    table = table.sort_by("node")
    vectors = _matrix(table["v"])
    layers = build_graph(vectors)
    return pa.table(
        {
            "dim": table["dim"][:1],
            "shard": table["shard"][:1],
            "vectors": [vectors.tobytes()],
            "members": [table["members"].to_pylist()],
            "nodes": [[x.nodes.astype(np.int32).tobytes() for x in layers]],
            "links": [[x.links.astype(np.int32).tobytes() for x in layers]],
        },
        schema=pa.schema(
            [
                ("dim", pa.int32()), ("shard", pa.int64()), ("vectors", pa.binary()), ("members", pa.list_(pa.list_(pa.int64()))),
                ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())),
            ]
        ),
    )


def _search(k: int):
    def solve(index: pa.Table, queries: pa.Table) -> pa.Table:
        rows = [[], [], []]
        if index.num_rows and queries.num_rows:
            dim = index["dim"][0].as_py()
            vectors = np.frombuffer(index["vectors"][0].as_py(), np.float64).reshape(-1, dim)
            layers = []
            for depth, (nodes, links) in enumerate(zip(index["nodes"][0].as_py(), index["links"][0].as_py())):
                layers.append(Layer(np.frombuffer(nodes, np.int32), np.frombuffer(links, np.int32).reshape(-1, LINKS if depth else LINKS0)))
            members = index["members"][0].as_py()
            wanted = _matrix(queries["v"])
            found = search_graph(vectors, layers, wanted)
            norm = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
            for i, query in enumerate(queries["id"].to_pylist()):
                at = found[i][found[i] >= 0]
                q = wanted[i]
                score = np.einsum("nd,d->n", vectors[at], q) / (norm[at] * np.sqrt(np.einsum("d,d->", q, q)))
                # ties at the border keep their smallest ids: every node as near as the last one wanted goes on
                border = np.sort(score)[::-1][min(k + 1, score.size) - 1] if score.size else 0
                for j, s in zip(at.tolist(), score.tolist()):
                    if s >= border:
                        for one in members[j]:
                            if one != query:
                                rows[0].append(query)
                                rows[1].append(one)
                                rows[2].append(s)
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "vec_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64())})

    return solve


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, dim)`` of vectors that have a direction: no null or non-finite components, not zero or empty."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest rows of ``vectors``, itself excepted.

    Nearness is the cosine in double precision; ties go to the smaller id.  Rows without an id, and vectors that
    are null, empty, zero, or hold null or non-finite components take no part on either side.  Vectors of
    different length do not meet.  Ids must be unique.  With fewer than ``k`` others all of them are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    base = usable(vectors, id_col, vector_col).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    same = W.partitionBy("dim", "h1", "h2").orderBy("id")
    # a query may be one of its copies, so one more than k
    few = base.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    nodes = few.groupBy("dim", "h1", "h2").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"), F.min_by("v", "id").alias("v"))
    nodes = scratch.save(nodes.drop("h1", "h2"), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    index = scratch.save(
        nodes.withColumn("shard", F.expr(f"pmod(xxhash64(node), {shards})")).groupBy("dim", "shard").applyInArrow(
            _index, "dim int, shard long, vectors binary, members array<array<long>>, nodes array<binary>, links array<binary>"
        ),
        "index",
    )
    scratch.forget(nodes)
    asked = usable(queries, id_col, vector_col)
    blocks = max(1, -(-asked.count() // QUERIES))
    left = index.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    right = asked.withColumn("block", F.expr(f"pmod(xxhash64(id), {blocks})")).withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(
        _search(k), "query_id long, vec_id long, score double"
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
