"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard.

Vectors are dealt by a hash of their id into shards of about SHARD_ROWS. Each shard builds a directed
graph: points are inserted in batches that at most double it; a greedy beam search proposes neighbours,
and relaxed distance pruning (a candidate goes if a kept neighbour is ALPHA times nearer to it than
the point is) keeps up to DEGREE diverse edges; edges back are pruned by the same rule. For inner
products the vectors get one more component that gives all of a shard the same norm, so that nearest
by distance and largest by product agree. Equal vectors of a shard are one node with a list of ids.

Queries are packed into blocks, and blocks into groups of GROUP_BLOCKS; every group visits every shard in a
task of its own, so that a task holds one shard and a bounded number of queries however many there are.
A beam search proposes candidates, and their products are computed again in double precision on the original vectors. The best of all shards
are merged. All rows are indexed; nothing is sampled.

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
components take no part; rows that repeat an id count once (the smallest vector); ties go to the smaller
id; vectors are compared with those of the same length only; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stored

SHARD_ROWS = 8192
DEGREE = 32
BEAM = 160
BUILD_BEAM = 80
ALPHA = 1.2
TOP = 20
QUERY_MODULUS = 20
BLOCK_QUERIES = 256
#: Blocks that one task searches; a shard's index goes to as many tasks as there are groups of them.
GROUP_BLOCKS = 64
EXPAND = 4
BATCH = 512
SEED_POINTS = 128


def beam_search(graph: np.ndarray, x: np.ndarray, queries: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam searches for many queries at once: ids and squared distances, nearest first; id -1 where none."""
    n, rows = len(graph), np.arange(len(queries))[:, None]
    norms = np.einsum("nd,nd->n", x, x)
    query_norms = np.einsum("nd,nd->n", queries, queries)

    def distances(ids: np.ndarray) -> np.ndarray:
        return norms[ids] - 2 * np.einsum("bkd,bd->bk", x[ids], queries) + query_norms[:, None]

    ids = np.full((len(queries), width), -1)
    d = np.full((len(queries), width), np.inf, np.float32)
    done = np.ones((len(queries), width), bool)
    seen = np.zeros((len(queries), n), bool)
    first = np.full((len(queries), 1), start)
    ids[:, :1], d[:, :1], done[:, 0] = first, distances(first), False
    seen[:, start] = True
    while True:
        order = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]  # the beam is sorted: the nearest that are open
        opened = ~done[rows, order]
        if not opened.any():
            return ids, d
        done[rows, order] = True
        near = graph[np.where(opened, ids[rows, order], 0)]
        near = np.where(opened[:, :, None], near, -1).reshape(len(queries), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.where(fresh, near, 0)
        fresh &= ~seen[rows, safe]
        at, _ = np.nonzero(fresh)
        seen[at, near[fresh]] = True
        new = np.where(fresh, distances(safe), np.inf).astype(np.float32)
        all_d = np.concatenate([d, new], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        keep = keep[rows, np.argsort(all_d[rows, keep], axis=1, kind="stable")]
        d = all_d[rows, keep]
        ids = np.where(np.isinf(d), -1, np.concatenate([ids, near], axis=1)[rows, keep])
        done = np.concatenate([done, ~fresh], axis=1)[rows, keep] | (ids < 0)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the up to `degree` diverse neighbours among its candidates (-1: none), nearest first."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)[:, ::-1]
    repeated = np.zeros(candidates.shape, bool)
    repeated[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    alive = (candidates >= 0) & ~repeated
    vectors = x[np.where(alive, candidates, 0)]
    squares = np.einsum("bkd,bkd->bk", vectors, vectors)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    own = vectors - x[points][:, None, :]
    d = np.where(alive, np.einsum("bkd,bkd->bk", own, own), np.inf)
    rows = np.arange(len(points))
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        best = np.where(alive, d, np.inf).argmin(axis=1)
        found = alive[rows, best]
        if not found.any():
            break
        out[found, k] = candidates[rows, best][found]
        alive &= ~((alpha * alpha * between[rows, best] <= d) & found[:, None])
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbours of each vector (-1 pads) and the node to start from. Deterministic."""
    n = len(x)
    graph = np.full((n, degree), -1)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
    order = np.random.Generator(np.random.PCG64(11)).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(np.int64) if n else order
    seed = order[:SEED_POINTS]
    graph[seed] = robust_prune(x, seed, np.tile(seed, (len(seed), 1)), degree, alpha)
    at = len(seed)
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(graph, x, x[batch], start, width)
        graph[batch] = robust_prune(x, batch, found, degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        nodes = target[first]
        for round_at in range(0, int(place.max(initial=-1)) + 1, degree):  # so many edges back at a time
            part = (place >= round_at) & (place < round_at + degree)
            incoming = np.full((len(nodes), degree), -1)
            incoming[np.searchsorted(nodes, target[part]), place[part] - round_at] = source[part]
            touched = (incoming >= 0).any(axis=1)
            for k in range(0, int(touched.sum()), BATCH):
                some = np.flatnonzero(touched)[k : k + BATCH]
                every = np.concatenate([graph[nodes[some]], incoming[some]], axis=1)
                fits = (every >= 0).sum(axis=1) <= degree
                if fits.any():  # nothing to choose
                    graph[nodes[some[fits]]] = -np.sort(-every[fits], axis=1)[:, :degree]
                if not fits.all():
                    graph[nodes[some[~fits]]] = robust_prune(x, nodes[some[~fits]], every[~fits], degree, alpha)
    return _reachable(graph, start), start


def _reachable(graph: np.ndarray, start: int) -> np.ndarray:
    """Chain nodes that no path reaches behind reached ones, in a column of their own."""
    n = len(graph)
    reached = np.zeros(n, bool)
    extra = np.full(n, -1)
    if n:
        reached[start] = True
    front = np.array([start]) if n else np.empty(0, np.int64)
    last = start
    while True:
        while len(front):
            near = np.unique(graph[front])
            near = near[near >= 0]
            front = near[~reached[near]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return np.column_stack([graph, extra])
        extra[last], last = lost[0], lost[0]
        reached[last] = True
        front = np.array([last])


def augmented(x: np.ndarray) -> np.ndarray:
    squares = (x.astype(float) ** 2).sum(axis=1)
    most = squares.max(initial=0.0)
    scale = 1 / math.sqrt(most) if most else 1.0
    return np.column_stack([x * scale, np.sqrt(np.maximum(0.0, most - squares)) * scale]).astype(np.float32)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim: without rows that take no part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    out = rows.select(F.col("vec_id").cast("long"), vector.alias("vector")).where("vec_id is not null and vector is not null")
    return out.where(finite & F.exists("vector", lambda v: v != 0)).withColumn("dim", F.size("vector"))


def once_per_id(rows: DataFrame) -> DataFrame:
    """valid_vectors with the smallest vector of each id: merged on the map side, so an id that many rows repeat is no hot key."""
    return valid_vectors(rows).groupBy("vec_id").agg(F.min(F.struct("vector", "dim")).alias("v")).select("vec_id", "v.vector", "v.dim")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


INDEX = "dim int, shard int, node int, vec_ids array<long>, vector array<double>, neighbours array<int>, start int"
_index_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("node", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64())), ("neighbours", pa.list_(pa.int32())), ("start", pa.int32())])


def _build(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("vector"), dim)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    distinct, node = np.unique(x, axis=0, return_inverse=True)
    by_node = np.argsort(node.ravel(), kind="stable")
    members = np.split(ids[by_node], np.cumsum(np.bincount(node.ravel(), minlength=len(distinct)))[:-1])
    graph, start = build_graph(augmented(distinct))
    n = len(distinct)
    return pa.Table.from_arrays(
        [pa.array([dim] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array([m.tolist() for m in members], pa.list_(pa.int64())), pa.array(list(distinct), pa.list_(pa.float64())), pa.array([g[g >= 0].tolist() for g in graph], pa.list_(pa.int32())), pa.array([start] * n, pa.int32())],
        schema=_index_schema,
    )


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, embedding -> INDEX, one row per distinct vector of a shard."""
    valid = stored(once_per_id(rows), "ann-vectors")
    shards = valid.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("n_shards"))
    dealt = valid.join(F.broadcast(shards), "dim") if shards.count() < 1000 else valid.join(shards, "dim")
    dealt = dealt.select("vec_id", "vector", "dim", F.pmod(F.xxhash64("vec_id"), F.col("n_shards").cast("long")).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX)


def _search_shard(top: int, beam: int):
    names = ["query_id", "vec_id", "score"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(index: pa.Table, blocks: pa.Table) -> Iterator[pa.Table] | pa.Table:
        if not index.num_rows or not blocks.num_rows:
            return schema.empty_table()
        dim, start = index.column("dim")[0].as_py(), index.column("start")[0].as_py()
        by_node = np.argsort(index.column("node").to_numpy())
        vectors = _matrix(index.column("vector"), dim)[by_node]
        lists = index.column("neighbours").to_pylist()
        lists = [lists[i] for i in by_node]
        graph = np.full((len(lists), max(1, max(map(len, lists)))), -1)
        for i, near in enumerate(lists):
            graph[i, : len(near)] = near
        members = index.column("vec_ids").to_pylist()
        members = [members[i] for i in by_node]
        x = augmented(vectors)
        parts = []
        for block in blocks.column("queries").to_pylist():
            query_ids = np.array([q["vec_id"] for q in block])
            q = np.array([q["vector"] for q in block])
            length = np.sqrt((q**2).sum(axis=1, keepdims=True))
            found, _ = beam_search(graph, x, np.column_stack([q / length, np.zeros(len(q))]).astype(np.float32), start, beam)
            for i, nodes in enumerate(found):
                nodes = np.arange(len(vectors)) if len(vectors) <= beam else nodes[nodes >= 0]
                scores = (vectors[nodes] * q[i]).sum(axis=1)
                rows = [(s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for v in members[node][: top + 1] if v != query_ids[i]]
                rows = sorted(rows, key=lambda r: (-r[0], r[1]))[:top]
                parts += [(int(query_ids[i]), v, s) for s, v in rows]
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*parts, strict=True) if parts else ([], [], []), schema, strict=True)], names=names)

    return search


def search(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """INDEX and vec_id, embedding of the queries -> query_id, rank, vec_id, score."""
    valid = stored(once_per_id(queries), "ann-queries")
    n_blocks = max(1, math.ceil(valid.count() / BLOCK_QUERIES))
    n_groups = math.ceil(n_blocks / group_blocks)
    packed = valid.groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("n_shards"))
    grouped = packed.join(shards, "dim").withColumn("part", F.pmod("block", F.lit(n_groups)).cast("int"))
    visits = grouped.select("dim", "part", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("shard"), "queries")
    if n_groups > 1:
        dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    else:
        dealt = index.withColumn("part", F.lit(0))
    key = ["dim", "shard", "part"]
    found = dealt.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_search_shard(top, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = stored(build_index(rows), "ann-index")
    return search(index, rows.where(F.col("vec_id") % QUERY_MODULUS == 0))
