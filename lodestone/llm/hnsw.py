"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Equal vectors are one node: the graph keeps the least id of each, and the ids of the copies that can be among
the results are joined back. So a vector that a third of all rows share is indexed once, and ties between
copies are exact. Every row is in the index; nothing is left to a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.vectors import finite_vectors, matrix

#: Distinct vectors in a shard, about; their number follows the table. A shard is one task's work and is held by it.
SHARD_ROWS = 8192
#: Queries that a task holds at a time, beside one shard.
QUERY_ROWS = 16384
#: Neighbours of a node above the ground layer; on it twice as many.
DEGREE = 16
#: Nodes that a search keeps while the graph is built, and while it is asked.
EF_BUILD, EF_SEARCH = 96, 192
#: Nodes opened in a step of a search, and searches that step together.
OPENED, TOGETHER = 4, 512


def beam(unit: np.ndarray, neighbours: np.ndarray, asked: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef best nodes met from the entry of each asked vector, best first (-1 where there are fewer), and their similarities."""
    n, rows = len(neighbours), np.arange(len(asked))
    ids, sims = np.full((len(asked), ef), -1, np.int32), np.full((len(asked), ef), -np.inf, np.float32)
    opened, seen = np.ones((len(asked), ef), bool), np.zeros((len(asked), n + 1), bool)
    ids[:, 0], sims[:, 0], opened[:, 0] = entry, np.einsum("rd,rd->r", unit[entry], asked), False
    seen[rows, entry] = True
    wide = min(OPENED, ef)
    while len(live := np.flatnonzero(~opened.all(1))):
        waiting = np.where(opened[live], -np.inf, sims[live])
        at = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]
        some = np.take_along_axis(waiting, at, 1) > -np.inf
        opened[live[:, None], at] |= some
        near = neighbours[np.where(some, ids[live[:, None], at], 0)]
        near = np.where(some[:, :, None], near, -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[live[:, None], near] = True
        seen[:, n] = False  # where -1 points
        fresh = np.einsum("rmd,rd->rm", unit[near], asked[live])
        fresh[near < 0] = -np.inf
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], fresh], 1)
        all_opened = np.concatenate([opened[live], near < 0], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], opened[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_opened))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def spread_out(unit: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates at most `most`: best first, those nearer to the row than to any taken before them; then the best of the rest."""
    out = np.full((len(ids), most), -1, np.int32)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    for a in range(0, len(ids), TOGETHER):
        i, s = ids[a : a + TOGETHER], sims[a : a + TOGETHER]
        x = unit[i]
        between = np.matmul(x, x.transpose(0, 2, 1))
        taken, valid = np.zeros(i.shape, bool), i >= 0
        for c in range(i.shape[1]):
            taken[:, c] = valid[:, c] & (taken.sum(1) < most) & ~(taken & (between[:, c, :] > s[:, c, None])).any(1)
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(np.where(valid, i, -1), rank, 1)
        out[a : a + TOGETHER, : best.shape[1]] = best
    return out


def joined_back(unit: np.ndarray, neighbours: np.ndarray, start: int, links: np.ndarray) -> None:
    """Link the neighbours of the new nodes (from start on) back to them; lists that overflow are spread out again."""
    most = neighbours.shape[1]
    to, of = links.ravel(), np.repeat(np.arange(start, start + len(links), dtype=np.int32), links.shape[1])
    to, of = to[links.ravel() >= 0], of[links.ravel() >= 0]
    if not len(to):
        return
    sims = np.einsum("rd,rd->r", unit[to], unit[of])
    order = np.lexsort((-sims, to))
    to, of = to[order], of[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    width = int(min(counts.max(), most))
    new = np.full((len(nodes), width), -1, np.int32)
    new[np.repeat(np.arange(len(nodes)), counts)[place < width], place[place < width]] = of[place < width]
    old = neighbours[nodes]
    new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)  # linked already, from the other end
    every = np.concatenate([old, new], 1)
    s = np.einsum("rmd,rd->rm", unit[every], unit[nodes])
    s[every < 0] = -np.inf
    over = (every >= 0).sum(1) > most
    order = np.argsort(-s, axis=1, kind="stable")
    neighbours[nodes] = np.take_along_axis(every, order, 1)[:, :most]
    if over.any():
        neighbours[nodes[over]] = spread_out(unit, every[over], s[over], most)


def layers_of(ids: np.ndarray) -> np.ndarray:
    """The highest layer of each id: geometric, from a hash, so that a task that runs again builds the same graph."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return (-np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / np.log(DEGREE)).astype(int)


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def built(unit: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Neighbour arrays by layer, from the ground up, of nodes that come highest layer first; sizes: nodes on each layer.

    Nodes are added in batches that double, up to TOGETHER: each finds its neighbours in the graph so far and in its batch.
    """
    graph = [np.full((n, DEGREE if layer else 2 * DEGREE), -1, np.int32) for layer, n in enumerate(sizes)]
    start = 0
    while start < len(unit):
        end = min(len(unit), start + min(TOGETHER, max(start, 32)))
        asked, entry = unit[start:end], np.zeros(end - start, np.int32)
        for layer in range(len(sizes) - 1, -1, -1):
            here = max(0, min(end, sizes[layer]) - start)  # new nodes on this layer come first
            known = min(start, sizes[layer])
            near, sims = np.full((here, 0), -1, np.int32), np.zeros((here, 0), np.float32)
            if known:
                if here:
                    near, sims = beam(unit, graph[layer], asked[:here], entry[:here], EF_BUILD)
                    entry[:here] = near[:, 0]
                if here < end - start:
                    entry[here:] = beam(unit, graph[layer], asked[here:], entry[here:], 1)[0][:, 0]
            if here > 1:
                within = asked[:here] @ asked[:here].T
                np.fill_diagonal(within, -np.inf)
                top = np.argsort(-within, axis=1, kind="stable")[:, : min(here - 1, 2 * DEGREE)]
                near, sims = np.concatenate([near, (top + start).astype(np.int32)], 1), np.concatenate([sims, np.take_along_axis(within, top, 1)], 1)
            if here and near.shape[1]:
                links = spread_out(unit, near, sims, DEGREE)
                graph[layer][start : start + here, :DEGREE] = links
                joined_back(unit, graph[layer], start, links)
        start = end
    return graph


def index_shard(table: pa.Table) -> pa.Table:
    """The graph of one shard: a row for each layer with its nodes' ids and flat neighbour array; the ground layer has the vectors too."""
    ids, x = np.asarray(table.column("rep").combine_chunks()), matrix(table.column("vector"))
    top = layers_of(ids)
    order = np.lexsort((ids, -top))
    ids, x, top = ids[order], x[order], top[order]
    graph = built(unit_of(x), [int((top >= layer).sum()) for layer in range(top[0] + 1)])
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * len(graph), pa.int32()),
        "layer": pa.array(range(len(graph)), pa.int32()),
        "ids": pa.array([ids[: len(g)] for g in graph], pa.list_(pa.int64())),
        "neighbours": pa.array([g.ravel() for g in graph], pa.list_(pa.int32())),
        "vectors": pa.array([x.ravel() if not k else None for k in range(len(graph))], pa.list_(pa.float64())),
    })


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of x[r, m] and q[r] in double precision, each sum in the order of the entries; an exact power of two keeps squares in range."""
    x, q = (np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1]) for v in (x, q))
    total = lambda a: np.add.accumulate(a, axis=-1)[..., -1]
    return total(x * q[:, None, :]) / (np.sqrt(total(x * x)) * np.sqrt(total(q * q))[:, None])


def search_shard(keep: int, ef: int):
    """f(index of a shard, queries) -> (query_id, rep, score): the `keep` best nodes found for each query, by exact score."""

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "rep": [], "score": []}
        if len(index) and len(queries):
            layers = {r["layer"]: r for r in index.select(["layer", "neighbours"]).to_pylist()}
            ground = index.filter(pc.equal(index.column("layer"), 0))
            ids = np.asarray(ground.column("ids").combine_chunks().flatten())
            x = np.asarray(ground.column("vectors").combine_chunks().flatten()).reshape(len(ids), -1)
            unit = unit_of(x)
            graph = [np.array(layers[k]["neighbours"], np.int32).reshape(-1, DEGREE if k else 2 * DEGREE) for k in range(len(layers))]
            asked, q = np.asarray(queries.column("query_id").combine_chunks()), matrix(queries.column("vector"))
            for a in range(0, len(q), TOGETHER):
                some = unit_of(q[a : a + TOGETHER])
                entry = np.zeros(len(some), np.int32)
                for g in graph[:0:-1]:
                    entry = beam(unit, g, some, entry, 1)[0][:, 0]
                found = beam(unit, graph[0], some, entry, max(ef, keep))[0]
                found = found[:, : max(4 * keep, 32)]
                score = cosines(x[found], q[a : a + TOGETHER])
                score[found < 0] = -np.inf
                order = np.lexsort((ids[found], -score), axis=1)[:, :keep]
                score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
                ok = found >= 0
                out["query_id"].append(np.repeat(asked[a : a + TOGETHER], ok.sum(1)))
                out["rep"].append(ids[found[ok]])
                out["score"].append(score[ok])
        kinds = {"query_id": np.int64, "rep": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *v]) for c, v in out.items()})

    return search


def nodes_of(vectors: DataFrame, copies: int) -> DataFrame:
    """(rep, vec_id, vector): of each distinct vector the `copies` least ids, and the least one's vector, as rep; written.

    The least ids of a group are found in the tasks that read it before the shuffle, so a vector of a third of
    all rows sends `copies` rows from each task.
    """
    one = vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    by = Window.partitionBy("vector").orderBy("vec_id")
    least = one.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= copies)
    marked = least.withColumn("rep", F.first("vec_id").over(by))
    return written(marked.select("rep", "vec_id", F.when(F.col("place") == 1, F.col("vector")).alias("vector")), "nodes")


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, layer, ids, neighbours, vectors): the graphs of all distinct vectors, written."""
    distinct = nodes.filter(F.col("vector").isNotNull())
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.select("rep", "vector", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    return written(dealt.groupBy("shard").applyInArrow(index_shard, "shard int, layer int, ids array<long>, neighbours array<int>, vectors array<double>"), "graphs")


def search(index: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each of queries (query_id, vector), but for the query's own id.

    k + 1 distinct vectors hold the k nearest rows, whatever their copies and ties.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    asked = queries.select("query_id", "vector", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = graphs.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(search_shard(k + 1, ef), "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    near = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    rows = near.join(nodes.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id meets `asked` (over vec_id) the k nearest other rows found, by cosine.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite entries, take no part;
    nor do those of another length than the most common. Of rows with one id the least vector counts, so a
    repeated row counts once. Ties go to the smaller id. Fewer candidates than k are all returned; an empty table
    gives no rows. Other columns are not read, whatever their names. A task holds one shard and QUERY_ROWS queries.
    """
    rows = finite_vectors(df, id_col, vector_col).filter(F.col("vec_id").isNotNull() & F.exists("vector", lambda c: c != 0))
    nodes = nodes_of(rows, k + 1)
    queries = rows.filter(asked).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumnRenamed("vec_id", "query_id")
    return search(build_index(nodes, shard_rows), nodes, queries, k, ef)
