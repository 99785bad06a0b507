"""Registered queries do the whole job: no rows left out by id."""

import numpy as np

import __spark_entry__ as entry
from lodestone.sources.corpus import Corpus, load

SMALL = entry.SMALL


def rows(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def heavy(spark):
    near = {}
    for r in entry.queries()["a7_author_edges"](spark, SMALL).filter("weight >= 2").collect():
        near.setdefault(r.node_a, {})[r.node_b] = r.weight
        near.setdefault(r.node_b, {})[r.node_a] = r.weight
    return near


def test_partners_and_paths_of_every_author(spark):
    near = heavy(spark)
    want = {(n, p, k) for n, own in near.items() for k, (_, p) in enumerate(sorted((-w, p) for p, w in own.items())[:20], 1)}
    assert {(r.node, r.partner, r["rank"]) for r in rows(spark, "g2_partners")} == want
    paths, last = set(), [(n,) for n in near]
    for _ in range(3):
        last = [(*p, x) for p in last for x in near[p[-1]] if x not in p]
        paths.update(last)
    got = [tuple(r.path) for r in rows(spark, "g4_paths")]
    assert len(got) == len(set(got)) and set(got) == paths


def test_every_name_is_asked(spark):
    got = {r.ask_id: r.status for r in rows(spark, "n1_resolve_authors")}
    assert got.keys() == {r.p_partkey for r in load(spark, SMALL, "part").select("p_partkey").collect()}
    assert {got[k] for k in got if k % 4 == 0} == {"resolved"} and {got[k] for k in got if k % 4 == 2} == {"not_found"} and {got[k] for k in got if k % 4 == 3} == {"skipped"}


def test_every_chunk_has_its_nearest_centroid(spark):
    c = Corpus(spark, SMALL).chunks.select("chunk_id", "embedding", "label").orderBy("chunk_id").collect()
    v, label = np.array([r.embedding for r in c], float), np.array([r.label for r in c])
    names = np.unique(label)
    centers = np.array([v[label == n].mean(0) for n in names])
    s = v @ centers.T / np.linalg.norm(v, axis=1, keepdims=True) / np.linalg.norm(centers, axis=1)
    got = {r.query_id: r for r in rows(spark, "v6_centroid")}
    assert got.keys() == {r.chunk_id for r in c}
    for k, r in enumerate(c):
        assert got[r.chunk_id].topic == names[s[k].argmax()] and abs(got[r.chunk_id].similarity - s[k].max()) < 1e-4


def test_copies_are_found_by_each_tier(spark):
    from lodestone.plans import answers

    r = answers.records(spark, SMALL)
    p = {x.publication_id: x for x in r.collect()}
    least, values = {k: k for k in p}, {}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for k, x in p.items():
        title = "".join(c for c in (x.title or "").lower() if c.isalnum() or c in "_ ").strip()
        for v in (x.doi and ("d", x.doi.lower()), x.eid and ("e", x.eid), title and ("t", title, x.year)):
            if v:
                a, b = sorted((root(values.setdefault(v, k)), root(k)))
                least[b] = a
    got = {x.key: x.group_key for x in rows(spark, "d3_dedup")}
    assert got == {k: root(k) for k in p}
    copies = [x for x in p.values() if x.publication_id.startswith("c")]
    assert {(bool(x.doi), bool(x.eid), bool(x.title)) for x in copies} >= {(True, False, False), (False, True, False), (False, False, True)}
    for x in copies:
        if x.doi or x.eid or x.title:
            assert got[x.publication_id] == got[x.publication_id[1:]]
    assert sum(x.records for x in rows(spark, "d4_merge")) == len(p) and len(rows(spark, "d4_merge")) == len(set(got.values()))
    some = spark.createDataFrame([("1", "10.1/a", None, "x", 1), ("2", "10.1/A", None, "y", 2)], "id string, doi string, eid string, title string, year int")
    from lodestone.operators import quality

    assert {x.group_key for x in quality.duplicate_groups(some, "id", answers._tiers()).collect()} == {"1"}  # a copy with an upper-case doi


def test_institutions_keep_all_their_publications(spark):
    got = rows(spark, "a8_keyword_institutions")
    assert all(len(r.via_publication_ids) == r.publication_count and r.via_publication_ids == sorted(set(r.via_publication_ids)) for r in got)
    assert max(r.publication_count for r in got) > 10


def test_betweenness_takes_every_shared_publication(spark, monkeypatch, tmp_path):
    """Over all edges, light ones too, whether tasks hold the graph or not, and in several batches of sources."""
    from lodestone.operators import blocks, graph
    from tests import golden
    from tests.test_core import brute_betweenness

    golden.write(str(tmp_path))
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet")).filter("l_orderkey in (2, 3, 5, 7, 9, 20)")
    lines.write.parquet(str(tmp_path / "few" / "lineitem.parquet"))
    edges = [(r.node_a, r.node_b) for r in entry.queries()["a7_author_edges"](spark, str(tmp_path / "few")).collect() if r.weight < 3]
    assert edges and len(edges) == entry.queries()["a7_author_edges"](spark, str(tmp_path / "few")).count()
    want = brute_betweenness(edges)
    assert any(want.values())
    monkeypatch.setattr(blocks, "PATHS_HELD", 30)
    query = entry.queries()["g9_betweenness"]
    got = [{r.node: r.betweenness for r in query(spark, str(tmp_path / "few")).collect()}]
    monkeypatch.setattr(blocks, "EDGES_HELD", 0)
    monkeypatch.setattr(graph, "BATCH_PATHS", 5 * len(want))
    got.append({r.node: r.betweenness for r in query(spark, str(tmp_path / "few")).collect()})
    for found in got:
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)
