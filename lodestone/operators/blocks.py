"""Weighted graphs as blocks of adjacency lists that tasks read as arrays; what nodes say of themselves is sent to every task.

A round over such a graph shuffles nothing: a block meets an array with a label for each node and hands back its own
nodes' labels. The arrays, some 12 bytes a node, are held by the driver and by each task, so graphs of more than
NODES_HELD nodes are refused here; graph has joins for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.keys import add_surrogate_key
from lodestone.sources.shared import tasks_for, written

#: Nodes whose labels are held by the driver and by every task.
NODES_HELD = 1 << 23
#: Edges, counted from either end, of a graph that is held whole by every task.
EDGES_HELD = 1 << 24
#: Numbers in an array of shortest paths, nodes by sources, or of what flows over edges at a time.
PATHS_HELD = 1 << 21

_BLOCK = "first long, kind string, counts binary, partners binary, weights binary, degrees binary, loops double"


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(values, start) if len(keys) else values


def _build(width: int, n: int) -> Callable[[pa.Table], pa.Table]:
    """f(rows of one block) -> the block: node, its partners, and the weight towards each of them. Repeated pairs add up."""

    def build(rows: pa.Table) -> pa.Table:
        lists = rows.column("partners").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        node, weight = (np.repeat(rows.column(c).to_numpy(), sizes) for c in ("node", "weight"))
        key, weight = _summed(node.astype(np.int64) * n + lists.flatten().to_numpy(), weight)
        node, partner = key // n, (key % n).astype(np.int32)
        first = int(rows.column("block")[0].as_py()) * width
        here = min(width, n - first)
        degree = np.bincount(node - first, weight, here)
        small = len(weight) == 0 or (weight.max() < 256 and weight.min() >= 0 and (weight == np.floor(weight)).all())
        kind = "u1" if small else "f8"
        counts = np.bincount(node - first, minlength=here).astype(np.int32)
        parts = {"first": [first], "kind": [kind], "counts": [counts.tobytes()], "partners": [partner.tobytes()], "weights": [weight.astype(kind).tobytes()], "degrees": [degree.tobytes()], "loops": [float(weight[node == partner].sum())]}
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(parts.items(), kinds)})

    return build


@dataclass
class Block:
    """Nodes first to first + len(degree), and an entry for each of their edges: row (node less first), partner, weight."""

    first: int
    row: np.ndarray
    partner: np.ndarray
    weight: np.ndarray
    degree: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    at = {c: i for i, c in enumerate(batch.schema.names)}
    for k in range(batch.num_rows):
        data = lambda c, kind: np.frombuffer(batch.column(at[c])[k].as_buffer() or b"", kind)
        counts = data("counts", np.int32)
        yield Block(batch.column(at["first"])[k].as_py(), np.repeat(np.arange(len(counts)), counts), data("partners", np.int32), data("weights", batch.column(at["kind"])[k].as_py()).astype(np.float64), data("degrees", np.float64))


@dataclass
class Adjacency:
    """A graph in blocks: n nodes (0 to n - 1), their degrees, and the sums of all weights and of those of loops, an edge counted from either end."""

    spark: SparkSession
    blocks: DataFrame
    n: int
    degree: np.ndarray
    total: float
    loops: float

    def over(self, f: Callable[..., tuple], sent: Broadcast, schema: str) -> DataFrame:
        """The rows of f(block, *sent.value) for each block, as columns of equal length."""
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in f(block, *sent.value)], names)

        return self.blocks.mapInArrow(run, schema)

    def gathered(self, f: Callable[..., tuple[np.ndarray, float]], *shared) -> tuple[np.ndarray, float]:
        """Labels of all nodes and a sum, from f(block, *shared) -> its nodes' labels and its part of the sum. shared is sent to every task."""
        sent = self.spark.sparkContext.broadcast(shared)
        found = self.over(lambda b, *s: _told(b, *f(b, *s)), sent, "first long, labels binary, inside double").collect()
        sent.destroy()
        out = np.arange(self.n, dtype=np.int32)
        for r in found:
            labels = np.frombuffer(r.labels, np.int32)
            out[r.first : r.first + len(labels)] = labels
        return out, math.fsum(r.inside for r in found)


def _told(block: Block, labels: np.ndarray, inside: float) -> tuple:
    return [block.first], [labels.astype(np.int32).tobytes()], [float(inside)]


def adjacency(near: DataFrame, n: int, entries: int) -> Adjacency:
    """The graph of near (node, partners, weight): a weight from a node to each of a list of partners, given from either end. entries: how many, about."""
    spark = near.sparkSession
    tasks = min(max(n, 1), tasks_for(spark, entries))
    width = max(1, -(-n // tasks))
    rows = near.select(F.floor(F.col("node") / width).cast("int").alias("block"), F.col("node").cast("int"), F.col("partners").cast("array<int>"), F.col("weight").cast("double"))
    blocks = written(rows.repartition(tasks, "block").groupBy("block").applyInArrow(_build(width, n), _BLOCK), "blocks")
    degree, loops = np.zeros(n), 0.0
    for r in blocks.select("first", "degrees", "loops").collect():
        own = np.frombuffer(r.degrees, np.float64)
        degree[r.first : r.first + len(own)] = own
        loops += r.loops
    return Adjacency(spark, blocks, n, degree, float(degree.sum()), loops)


def names_of(df: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """(name, id): the distinct values of the columns, numbered from 0 in their order, and how many there are."""
    each = written(df.select(F.explode(F.array(*columns)).alias("name")).distinct(), "distinct")  # ranges are sampled first
    names = written(add_surrogate_key(each, ["name"], "id").select("name", (F.col("id") - 1).alias("id")), "names")
    return names, names.count()


def of_edges(edges: DataFrame, names: DataFrame, n: int) -> Adjacency:
    """The graph of edges (node_a, node_b, weight), each once."""
    a, b = (names.select(F.col("name").alias(c), F.col("id").alias(i)).hint("shuffle_hash") for c, i in (("node_a", "a"), ("node_b", "b")))
    numbers = written(edges.select("node_a", "node_b", "weight").join(a, "node_a").join(b, "node_b").select("a", "b", "weight"), "pairs")
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.array("b").alias("partners")), F.struct(F.col("b").alias("node"), F.array("a").alias("partners"))))
    return adjacency(numbers.select(ends, "weight"), n, 2 * numbers.count())


def of_lists(lists: DataFrame, n: int) -> Adjacency:
    """The graph of lists (items, an array of distinct node numbers): nodes are linked by as many lists as they share."""
    size = F.size("items")
    entries = lists.agg(F.sum(size.cast("long") * (size - 1))).first()[0] or 0
    each = lists.filter(size > 1).select(F.explode("items").alias("node"), "items")
    return adjacency(each.select("node", F.array_remove("items", F.col("node")).alias("partners"), F.lit(1.0).alias("weight")), n, entries)


def merged(graph: Adjacency, community: np.ndarray, n: int) -> Adjacency:
    """The graph of the n communities of graph's nodes; edges within one become its loop."""

    def pairs(block: Block, to: np.ndarray) -> tuple:
        a, b = to[block.first + block.row].astype(np.int64), to[block.partner]
        key, weight = _summed(a * n + b, block.weight)
        return (key // n).astype(np.int64), (key % n).astype(np.int64), weight

    sent = graph.spark.sparkContext.broadcast((community,))
    rows = written(graph.over(pairs, sent, "node long, partner long, weight double"), "merged")
    sent.destroy()
    return adjacency(rows.select("node", F.array("partner").alias("partners"), "weight"), n, rows.count())


def _around(block: Block, community: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, community, weight): the weight of each node of the block towards each community about it, its own with weight own where that is given."""
    row, towards, weight = block.row, community[block.partner], block.weight
    # A loop leads to the node's own community without a weight.
    weight = np.where(block.partner == block.first + row, 0.0, weight)
    if own is not None:
        rows = np.flatnonzero(own > 0)
        row, towards, weight = np.append(row, rows), np.append(towards, community[block.first + rows]), np.append(weight, own[rows])
    key, weight = _summed(row.astype(np.int64) * n + towards, weight)
    return key // n, key % n, weight


def _first_of_best(row: np.ndarray, community: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `size` rows the greatest value and the least community that has it; minus infinity and -1 for rows without any."""
    best, which = np.full(size, -np.inf), np.full(size, -1, np.int64)
    if len(row):
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        top = np.maximum.reduceat(value, start)
        best[row[start]] = top
        at = value == np.repeat(top, np.diff(np.append(start, len(row))))
        which[row[start]] = np.minimum.reduceat(np.where(at, community, np.iinfo(np.int64).max), start)
    return best, which


def spread_labels(graph: Adjacency, rounds: int) -> np.ndarray:
    """Labels by propagation: each node takes the label with the most weight around it, the least of equals; its own has the weight of its heaviest edge."""
    n = graph.n

    def turn(block: Block, labels: np.ndarray) -> tuple:
        here = len(block.degree)
        own = np.zeros(here)
        np.maximum.at(own, block.row, block.weight)
        _, best = _first_of_best(*_around(block, labels, n, own), here)
        return np.where(best < 0, labels[block.first : block.first + here], best), 0.0

    labels = np.arange(n, dtype=np.int32)
    for _ in range(rounds):
        labels, _ = graph.gathered(turn, labels)
    return labels


def quality(graph: Adjacency, labels: np.ndarray) -> float:
    """The modularity of labels."""
    if not graph.total:
        return 0.0

    def within(block: Block, labels: np.ndarray) -> tuple:
        return labels[block.first : block.first + len(block.degree)], block.weight[labels[block.first + block.row] == labels[block.partner]].sum()

    inside = graph.gathered(within, labels)[1]
    return inside / graph.total - float((np.bincount(labels, graph.degree) ** 2).sum()) / graph.total**2


def hashes_of(names: DataFrame, n: int) -> np.ndarray:
    """xxhash64 of each name, by its number."""
    found = names.select("id", F.xxhash64("name").alias("hash")).toArrow()
    out = np.zeros(n, np.uint64)
    out[found.column("id").to_numpy()] = found.column("hash").to_numpy().view(np.uint64)
    return out


def _half(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Which nodes may move in a turn: those whose xxhash64 of name and turn is even."""
    first, second, third = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    h = (hashes + np.uint64(0x27D4EB2F165667C5 + 4)) ^ np.uint64(turn * 0x9E3779B185EBCA87 % 2**64)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * second + third
    h = (h ^ (h >> np.uint64(33))) * second
    h = (h ^ (h >> np.uint64(29))) * third
    return (h ^ (h >> np.uint64(32))) & np.uint64(1) == 0


def moves(block: Block, community: np.ndarray, size: np.ndarray, half: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """The block's labels after the nodes of half have taken the community about them with the greatest gain of modularity.

    Also what tells the quality of the labels before: the weight of its nodes towards their own communities.
    """
    here, n = len(block.degree), len(community)
    home = community[block.first : block.first + here].astype(np.int64)
    row, towards, inward = _around(block, community, n)
    at_home = towards == home[row]
    gain = np.round(inward - block.degree[row] * (size[towards] - np.where(at_home, block.degree[row], 0.0)) / total, 9)
    best, which = _first_of_best(row, towards, gain, here)
    # Where no neighbour is at home, staying gains what a community without links to the node would.
    stay = np.round(0.0 - block.degree * (size[home] - block.degree) / total, 9)
    stay[row[at_home]] = gain[at_home]
    goes = half[block.first : block.first + here] & (best > stay)
    return np.where(goes, which, home), inward[at_home].sum()


def best_communities(graph: Adjacency, hashes: np.ndarray, least: float, turns: int) -> np.ndarray:
    """A community number for each node by modularity gain; see graph.louvain. hashes: hashes_of the nodes' names."""
    members = np.arange(graph.n, dtype=np.int32)
    if not graph.total:
        return members
    top = None
    while True:
        now = np.arange(graph.n, dtype=np.int32)
        start = best = kept = None
        idle, turn = 0, 0
        while True:
            size = np.bincount(now, graph.degree, graph.n)
            after, within = graph.gathered(moves, now, size, _half(hashes, turn + 1), graph.total)
            q = (within + graph.loops) / graph.total - float((size**2).sum()) / graph.total**2
            if best is None:
                start, best, kept = q, q, now
            else:
                idle = 0 if q > best + least else idle + 1
                if q > best:
                    best, kept = q, now
            if idle >= 3 or turn >= turns:
                break
            turn += 1
            now = after
        if best <= start + least and top is not None:
            return members
        found, dense = np.unique(kept, return_inverse=True)
        members = dense.astype(np.int32)[members]
        if best <= start + least:
            return members
        top = best
        # A community goes by the node that its label numbers.
        graph, hashes = merged(graph, dense.astype(np.int32), len(found)), hashes[found]


def labelled(graph: Adjacency, names: DataFrame, labels: np.ndarray) -> DataFrame:
    """(node, community) of nodes with edges, a community by the name of the node that its label numbers."""
    sent = graph.spark.sparkContext.broadcast((labels, graph.degree > 0))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, linked = sent.value
        for batch in batches:
            i = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to[i].astype(np.int64))], ["node", "id"]).filter(pa.array(linked[i]))

    kind = dict(names.dtypes)["name"]
    found = names.select("name", F.col("id").cast("long").alias("id")).mapInArrow(told, f"node {kind}, id long")
    return found.join(names.select("id", F.col("name").alias("community")).hint("shuffle_hash"), "id").select("node", "community")


def least_members(labels: np.ndarray) -> np.ndarray:
    """Labels with each community's number replaced by its least node."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return first.astype(np.int32)[at]


def dependencies(counts: np.ndarray, partners: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each node the share of shortest paths from the sources that lead through it (Brandes), summed over all targets. All sources go level by level together."""
    n, at = len(counts), np.append(0, np.cumsum(counts, dtype=np.int64))
    some = max(1, PATHS_HELD // max(1, len(sources)))
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + some, "right")) - 1))

    def through(f: np.ndarray) -> np.ndarray:
        out = np.zeros_like(f)
        for lo, hi in zip(cuts, cuts[1:]):
            rows = lo + np.flatnonzero(counts[lo:hi])
            if len(rows):
                out[rows] = np.add.reduceat(f[partners[at[lo] : at[hi]]], at[rows] - at[lo], axis=0)
        return out

    level = np.full((n, len(sources)), -1, np.int32)
    sigma = np.zeros((n, len(sources)))
    level[sources, np.arange(len(sources))], sigma[sources, np.arange(len(sources))] = 0, 1.0
    front, last = sigma, 0
    while (level < 0).any():
        reached = through(front)
        fresh = (reached > 0) & (level < 0)
        if not fresh.any():
            break
        last += 1
        level[fresh], front = last, np.where(fresh, reached, 0.0)
        sigma = sigma + front
    delta = np.zeros_like(sigma)
    for k in range(last, 1, -1):  # a source has no share of its own paths
        given = through(np.divide(1 + delta, sigma, out=np.zeros_like(sigma), where=level == k))
        delta = np.where(level == k - 1, sigma * given, delta)
    return delta.sum(axis=1)


def through_nodes(graph: Adjacency, sources: np.ndarray) -> DataFrame:
    """(id, b): dependencies of each node, summed over the sources (numbers of nodes), which are dealt over tasks. The graph has at most EDGES_HELD entries."""
    spark, n = graph.spark, graph.n
    counts, partners = np.zeros(n, np.int32), []
    for r in sorted(graph.blocks.select("first", "counts", "partners").collect()):
        own = np.frombuffer(r.counts, np.int32)
        counts[r.first : r.first + len(own)] = own
        partners.append(np.frombuffer(r.partners, np.int32))
    sent = spark.sparkContext.broadcast((counts, np.concatenate(partners) if partners else np.zeros(0, np.int32), sources.astype(np.int64)))
    together = min(64, max(1, PATHS_HELD // max(1, n)))
    batches_ = -(-len(sources) // together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, partners, sources = sent.value
        total = np.zeros(n)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                total += dependencies(counts, partners, sources[k * together : (k + 1) * together])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "b"])

    tasks = max(1, min(batches_, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, batches_, 1, tasks).mapInArrow(run, "id long, b double").groupBy("id").agg(F.sum("b").alias("b"))
