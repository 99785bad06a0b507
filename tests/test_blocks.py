"""Graphs in blocks of adjacency lists: the same labels as by joins, and rounds that shuffle nothing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks, graph
from lodestone.sources import shared

EDGES = "node_a string, node_b string, weight int, via array<string>"


def memberships(seed, groups=60, items=30, most=5):
    r = random.Random(seed)
    return [(f"g{g}", f"n{i}") for g in range(groups) for i in r.choices(range(items), k=r.randint(1, most))] + [("g0", None), (None, "n1"), ("alone", "lonely")]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, i string")


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(store.apply(k).totalShuffleWrite() for k in range(store.size()))


@pytest.mark.parametrize("piece", [256, 2])
def test_adjacency_of_groups(spark, monkeypatch, piece):
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    monkeypatch.setattr(graph, "PAIR_BLOCK", piece)
    rows = memberships(1)
    g, names = graph.adjacency_of(table(spark, rows), "g", "i")
    want = {}
    for _, same in itertools.groupby(sorted((a, b) for a, b in rows if a and b), key=lambda x: x[0]):
        for a, b in itertools.permutations(sorted({b for _, b in same}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    name = {r.id: r.name for r in names.collect()}
    got = {}

    def pairs(block):
        return (block.first + block.row).astype(np.int64), block.partner.astype(np.int64), block.weight

    for r in g.over(pairs, spark.sparkContext.broadcast(()), "a long, b long, w double").collect():
        got[name[r.a], name[r.b]] = r.w
    assert got == want and g.blocks.count() > 1
    assert g.total == sum(want.values()) and g.degree[[i for i, n in name.items() if n == "lonely"]] == 0
    assert [name[i] for i in sorted(name)] == sorted(name.values())


def test_labels_in_blocks_are_those_of_joins(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    rows = table(spark, memberships(2, 40, 40, 3))
    held = graph.adjacency_of(rows, "g", "i")
    edges = graph.collaboration_edges(rows, "g", "i")
    joined = {r.node: r.community for r in graph.communities_by_joins(edges).collect()}
    assert {r.node: r.community for r in graph.communities_in(*held).collect()} == joined
    assert {r.node: r.community for r in graph.communities(edges).collect()} == joined and "lonely" not in joined
    best = graph.louvain_in(*held)
    assert {r.node: r.community for r in best.collect()} == {r.node: r.community for r in graph.louvain_by_joins(edges).collect()}
    told = {r.method: r for r in graph.modularities(*held).collect()}
    assert told["louvain"].modularity == pytest.approx(graph.modularity(edges, best).first().modularity, abs=2e-6)
    assert told["label_propagation"].modularity == pytest.approx(graph.modularity(edges, graph.communities_in(*held)).first().modularity, abs=2e-6)
    assert told["louvain"].communities == best.select(F.countDistinct("community")).first()[0]


def test_a_round_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    g, _ = graph.adjacency_of(table(spark, memberships(3, 200, 30, 6)), "g", "i")
    before = shuffled(spark)
    now = np.arange(g.n, dtype=np.int32)
    after, _ = g.gathered(blocks.moves, now, np.bincount(now, g.degree, g.n), np.ones(g.n, bool), g.total)
    blocks.spread_labels(g, 2)
    assert shuffled(spark) == before and (after != now).any()


def test_more_nodes_than_blocks_hold_go_by_joins(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NODES_HELD", 3)
    edges = spark.createDataFrame([(a, b, 1, [a]) for a, b in ("ab", "bc", "ac", "xy", "yz", "xz")], EDGES)
    rows = edges.select(F.concat("node_a", "node_b").alias("g"), F.explode(F.array("node_a", "node_b")).alias("i"))
    assert graph.adjacency_of(rows, "g", "i") is None and graph.held(edges) is None
    assert {r.node: r.community for r in graph.louvain(edges).collect()} == dict(a="a", b="a", c="a", x="x", y="x", z="x")
