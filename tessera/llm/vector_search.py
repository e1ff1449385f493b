"""Approximate nearest neighbours by largest inner product: one robust-pruned directed graph for each shard.

Inner products become Euclidean distances by one more coordinate, sqrt(largest norm ** 2 - norm ** 2). Graphs are
built by insertion in growing batches: a greedy beam search from the entry proposes neighbours, pruning drops a
candidate that is closer (by the factor ALPHA) to a neighbour already chosen, so that edges stay diverse, and the
reverse edges are added and pruned likewise. A query goes by beam search through every shard: the work is queries times
shards, dealt out evenly by (shard, block of queries).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import at_home, partitions, stored

#: Edges of a node, width of the beams for building and for searching, slack of the pruning, nodes expanded at once.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, EXPAND = 32, 64, 128, 1.2, 4
#: Vectors in a shard, queries in a block (what one task holds), queries searched together.
SHARD, QUERY_BLOCK, TOGETHER = 8192, 1024, 256


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The beam's nodes for each query, nearest first, -1 where there are fewer. All queries advance side by side."""
    many, width = len(queries), beam + EXPAND * edges.shape[1]
    norm = (points**2).sum(1)
    ids = np.full((many, beam), -1, np.int64)
    dist = np.full((many, beam), np.inf, np.float32)
    done = np.ones((many, beam), bool)
    seen = np.zeros((many, len(points)), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = norm[entry] - 2 * (queries @ points[entry])
    live = np.arange(many)
    while len(live):
        rank = np.where(done[live], np.inf, dist[live])
        picks = np.argpartition(rank, EXPAND - 1, axis=1)[:, :EXPAND]
        open_ = np.isfinite(np.take_along_axis(rank, picks, 1))
        rows = live[:, None]
        done[rows, picks] = True
        near = np.where(open_[:, :, None], edges[np.maximum(ids[rows, picks], 0)], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows, np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        node = near[r, c]
        seen[live[r], node] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = norm[node] - 2 * np.einsum("ij,ij->i", points[node], queries[live[r]])
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if width > beam else np.arange(beam)[None]
        dist[live], ids[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))
        gone = ~np.isfinite(dist[live])
        ids[live] = np.where(gone, -1, ids[live])
        done[live] |= gone
        live = live[~done[live].all(1)]
    order = np.argsort(dist, axis=1)
    return np.take_along_axis(ids, order, 1)


def robust_prune(points: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Up to degree diverse neighbours (then -1) for each node out of its row of candidates (-1: none)."""
    many, wide = candidates.shape
    x = points[np.maximum(candidates, 0)]
    to_node = ((x - points[node][:, None]) ** 2).sum(2)
    bad = (candidates < 0) | (candidates == node[:, None])
    to_node[bad] = np.inf
    order = np.argsort(to_node, axis=1)
    candidates, to_node = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_node, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    norm = (x**2).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(to_node)
    out = np.full((many, degree), -1, np.int64)
    row = np.arange(many)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = np.argmax(alive, axis=1)
        out[has, k] = candidates[row, pick][has]
        alive &= ALPHA**2 * between[row, pick] > to_node
        alive[row, pick] = False
    return out


def _add_reverse(points: np.ndarray, edges: np.ndarray, node: np.ndarray) -> None:
    """Give the new nodes' neighbours an edge back, and prune those that then have too many."""
    source = np.repeat(node, edges.shape[1])
    target = edges[node].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, begin, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(at), TOGETHER):
        t, b, n = at[lo : lo + TOGETHER], begin[lo : lo + TOGETHER], count[lo : lo + TOGETHER]
        extra = np.full((len(t), n.max()), -1, np.int64)
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        extra[np.repeat(np.arange(len(t)), n), cell] = source[np.repeat(b, n) + cell]
        wide = np.concatenate([edges[t], extra], axis=1)
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        held = (wide >= 0).sum(1)
        room = held <= edges.shape[1]
        edges[t[room]] = wide[room][:, : edges.shape[1]]
        if not room.all():
            full = wide[~room][:, : held.max()]
            edges[t[~room]] = robust_prune(points, t[~room], full, edges.shape[1])


def build_graph(points: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (DEGREE for each node, -1: none) and the entry, the point nearest to the mean."""
    n = len(points)
    edges = np.full((n, DEGREE), -1, np.int64)
    entry = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    rest = np.random.Generator(np.random.PCG64(seed)).permutation(np.delete(np.arange(n), entry))
    at, step = 0, 1
    while at < len(rest):
        batch = rest[at : at + step]
        found = [beam_search(points, edges, entry, points[batch[i : i + TOGETHER]], BUILD_BEAM) for i in range(0, len(batch), TOGETHER)]
        for i, nodes in enumerate(found):
            part = batch[i * TOGETHER : (i + 1) * TOGETHER]
            edges[part] = robust_prune(points, part, nodes, DEGREE)
        _add_reverse(points, edges, batch)
        at, step = at + len(batch), min(1024, max(1, (at + len(batch)) // 2))
    return edges, entry


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that turns largest inner products into smallest distances."""
    norm = (vectors**2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)


def _usable(table: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of vectors that are not null, not zero, and hold finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _graphs(rows: DataFrame, k: int) -> DataFrame:
    """A row for each shard: vectors, members of each (the k + 1 smallest vec_id of equal vectors), edges and entry."""
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    first = hashed.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    distinct = stored(first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.collect_list("vec_id").alias("members")), "vectors")
    shards = max(1, -(-distinct.count() // SHARD))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        members = group.column("members").to_pylist()
        dim = key[0].as_py()
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort([min(m) for m in members])  # one graph for one content, in whatever order rows arrive
        vectors, members = vectors[order], [sorted(members[i]) for i in order]
        edges, entry = build_graph(lifted(vectors))
        ends = np.cumsum([0, *map(len, members)])
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "entry": pa.array([entry], pa.int32()),
            "vectors": [vectors.tobytes()], "edges": [edges.astype(np.int32).tobytes()],
            "ends": [ends.astype(np.int64).tobytes()], "ids": [np.concatenate([np.array(m, np.int64) for m in members]).tobytes()],
        })

    dealt = distinct.select(F.size("v").alias("dim"), F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), "v", "members")
    made = dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, entry int, vectors binary, edges binary, ends binary, ids binary")
    return stored(made, "graphs")


def nearest(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of table nearest to each of queries, its own left out.

    Both have vec_id and embedding. Nearest is the largest inner product in double precision on the original
    vectors, ties to the smaller vec_id; scores are exact, the choice is approximate. Equal vectors are one node, so
    that a vector held by many rows fills neither the graph nor the beam; its k + 1 smallest ids suffice for any
    query. Every row is indexed. Vectors that are null, zero or hold null or non-finite components take no part, nor
    do rows without vec_id. Vectors are compared with those of their own length only. Repeated rows (a vec_id twice
    with one vector) count once.
    """
    table, queries = at_home(table, queries)
    graphs = _graphs(_usable(table).distinct(), k)
    asked = _usable(queries).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")})
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    asked = asked.select("dim", "block", F.col("queries.vec_id").alias("query_ids"), F.flatten("queries.v").alias("query_vectors"))
    # every block goes to every shard; where shards are fewer than tasks, several copies of a shard share its blocks
    shards = graphs.agg(F.coalesce(F.max("shard") + 1, F.lit(1)).alias("n")).first().n
    copies = min(blocks, max(1, -(-partitions(asked.sparkSession) // shards)))
    keys, tasks = ["dim", "shard", "copy"], 4 * shards * copies
    sent = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % copies).alias("copy"), "query_ids", "query_vectors")
    kept = graphs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    work = sent.repartition(tasks, *keys).hint("merge").join(kept.repartition(tasks, *keys), keys)
    work = work.select("dim", "entry", "vectors", "edges", "ends", "ids", "query_ids", "query_vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim, entry = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                vectors = np.frombuffer(batch.column(2)[row].as_buffer(), np.float64).reshape(-1, dim)
                edges = np.frombuffer(batch.column(3)[row].as_buffer(), np.int32).reshape(len(vectors), -1).astype(np.int64)
                ends, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (4, 5))
                q_ids = batch.column(6)[row].values.to_numpy(zero_copy_only=False)
                q = batch.column(7)[row].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                points = lifted(vectors)
                aimed = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
                out = ([], [], [])
                for lo in range(0, len(q), TOGETHER):
                    near = beam_search(points, edges, entry, aimed[lo : lo + TOGETHER], SEARCH_BEAM)
                    for i, nodes in enumerate(near):
                        nodes = nodes[nodes >= 0]
                        score = (vectors[nodes] * q[lo + i]).sum(1)
                        n = ends[nodes + 1] - ends[nodes]
                        who = ids[np.repeat(ends[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                        score = np.repeat(score, n)
                        score, who = score[who != q_ids[lo + i]], who[who != q_ids[lo + i]]
                        best = np.lexsort((who, -score))[:k]
                        out[0].append(np.full(len(best), q_ids[lo + i]))
                        out[1].append(who[best])
                        out[2].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
