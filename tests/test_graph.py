"""Paths over hubs and communities by modularity, against plain loops."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, spread

EDGES = "node_a string, node_b string, weight int, via array<string>"


def table(spark, pairs):
    return spark.createDataFrame([(*sorted((a, b)), w, [f"{a}{b}"]) for a, b, w in pairs], EDGES)


def walks(pairs, sources, most, target):
    near, edge = {}, {}
    for a, b, w in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        edge[frozenset((a, b))] = (w, f"{a}{b}")
    out, now = [], [(s,) for s in sources]
    for _ in range(most):
        now = [(*p, n) for p in now for n in near.get(p[-1], ()) if n not in p]
        out += [(p[0], p[-1], p, len(p) - 1, *edge[frozenset(p[-2:])]) for p in now if target in (None, p[-1])]
    return sorted(out)


@pytest.mark.parametrize("target", [None, "h", "a3", "none"])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_paths_over_a_hub(spark, monkeypatch, target, most):
    monkeypatch.setattr(spread, "PIECE", 3)
    pairs = [("h", f"a{i}", i) for i in range(9)] + [("a1", "a2", 5), ("a2", "a3", 6), ("a3", "a4", 7), ("x", "y", 1)]
    sources = ["a1", "h", "x", "lone"]
    got = graph.paths(table(spark, pairs), spark.createDataFrame([(s,) for s in sources], "node string"), most, target)
    assert sorted((r.source, r.target, tuple(r.path), r.hops, r.weight, r.via[0]) for r in got.collect()) == walks(pairs, sources, most, target)


def quality(pairs, labels):
    m = sum(w for _, _, w in pairs)
    inside = sum(w for a, b, w in pairs if labels[a] == labels[b])
    size = {}
    for a, b, w in pairs:
        for x in (a, b):
            size[labels[x]] = size.get(labels[x], 0) + w
    return inside / m - sum(d * d for d in size.values()) / (4 * m * m)


def partitions(items):
    if not items:
        yield {}
        return
    for rest in partitions(items[1:]):
        for c in [*set(rest.values()), items[0]]:
            yield {**rest, items[0]: c}


CLIQUES = [(a, b, 1) for group in ("abcd", "efgh") for a, b in itertools.combinations(group, 2)] + [("d", "e", 1)]


@pytest.mark.parametrize("pairs", [CLIQUES, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("f", "g", 1), ("g", "h", 1)], [("a", "b", 9), ("b", "c", 1), ("c", "a", 1), ("c", "d", 7), ("x", "y", 2)]])
def test_louvain_against_all_partitions(spark, pairs):
    edges = table(spark, pairs)
    found = graph.louvain(edges)
    labels = {r.node: r.community for r in found.collect()}
    nodes = sorted({x for p in pairs for x in p[:2]})
    assert sorted(labels) == nodes and all(c == min(n for n in nodes if labels[n] == c) for c in labels.values())
    best = max(quality(pairs, p) for p in partitions(nodes))
    assert quality(pairs, labels) >= 0.95 * best
    assert graph.modularity(edges, found).first().modularity == pytest.approx(quality(pairs, labels), abs=1e-6)
    assert quality(pairs, labels) >= quality(pairs, {r.node: r.community for r in graph.communities(edges).collect()}) - 1e-9


def test_louvain_of_no_edges_and_of_many_cliques(spark):
    assert graph.louvain(table(spark, [])).collect() == []
    pairs = [(f"{k:02}{a}", f"{k:02}{b}", 1) for k in range(12) for a, b in itertools.combinations("abcde", 2)] + [(f"{k:02}a", f"{(k + 1) % 12:02}b", 1) for k in range(12)]
    edges = table(spark, pairs)
    labels = {r.node: r.community for r in graph.louvain(edges).collect()}
    assert all(len({labels[f"{k:02}{x}"] for x in "abcde"}) == 1 for k in range(12))
    assert quality(pairs, labels) >= quality(pairs, {r.node: r.community for r in graph.communities(edges).collect()})
    assert graph.louvain(edges).select(F.countDistinct("community")).first()[0] == len(set(labels.values()))
