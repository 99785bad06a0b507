"""Names by their pieces, spread joins, exact quantiles, tiles of the vector search: against plain loops, in pieces small enough to matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities, evaluate, evidence, spread, topics, vector
from lodestone.plans import research
from lodestone.sources.corpus import Corpus


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "PIECE", 4)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("b", 2), (None, 3)], "k string, l int")
    right = spark.createDataFrame([("hot", i) for i in range(23)] + [("a", 7), ("b", 8), ("c", 9), (None, 3)], "k string, r int")
    got = sorted(map(tuple, spread.spread_join(left, right, ["k"]).select("k", "l", "r").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "l", "r").collect())) and len(got) == 50 * 23 + 3
    assert spread.spread_join(left.limit(0), right, ["k"]).count() == 0


@pytest.mark.parametrize("rows_each", [7, 100_000])
def test_exact_quantiles(spark, rows_each, monkeypatch):
    r = np.random.default_rng(2)
    rows = [("hot", 5.0)] * 200 + [("hot", float(x)) for x in r.normal(size=101)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 4.0), ("none", None)]
    real = spread.ranked_counts
    monkeypatch.setattr(spread, "ranked_counts", lambda *a: real(*a, rows_each=rows_each))
    got = {x.g: (x.median, x.p95, x.p10) for x in spread.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"median": 0.5, "p95": 0.95, "p10": 0.1}).collect()}
    want = {g: tuple(np.percentile([v for h, v in rows if h == g and v is not None], [50, 95, 10])) for g in ("hot", "one", "two", None)}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g], rtol=1e-14) for g in want)


def test_names_that_contain_others(spark, monkeypatch):
    monkeypatch.setattr(spread, "PIECE", 3)
    r = np.random.default_rng(4)
    names = sorted({"".join(r.choice(list("abc é"), r.integers(1, 9))) for _ in range(200)})
    asked = [n for n in names[::3] if len(n) >= 3] + ["zzz", "abc", "a b"]
    got = entities.containing(spark.createDataFrame([(a,) for a in asked] * 2, "low string"), spark.createDataFrame([(n,) for n in names] * 2, "entity_low string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, n) for a in asked for n in names if a in n})
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("NestedLoop" in line and "Contains" in line for line in plan)


def test_conditions_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    monkeypatch.setattr(vector, "TILE_QUERIES", 3)
    r = np.random.default_rng(6)
    n = 150
    v = r.normal(size=(n, 8)).astype(np.float32).astype(float)
    v[40:60] = v[40]  # ties
    year = [None if i % 11 == 0 else 2000 + i % 5 for i in range(n)]
    kind = [None if i % 7 == 0 else "ab"[i % 2] for i in range(n)]
    chunks = spark.createDataFrame([(i, i // 2, v[i].tolist(), year[i], kind[i]) for i in range(n)] + [(900, 1, None, 2001, "a"), (901, 1, [0.0] * 8, 2001, "a")], "chunk_id long, publication_id long, embedding array<float>, year int, document_type string").repartition(4)
    ask = [(None, None, None, None), (2001, None, None, None), (None, 2002, "a", None), (2001, 2003, None, None), (None, None, "b", [1, 5, 20, 22]), (None, None, None, []), (2010, None, None, None)]
    queries = spark.createDataFrame([(i, v[3 * i].tolist(), *a) for i, a in enumerate(ask * 2)], "query_id long, embedding array<float>, year_low int, year_high int, document_type string, publication_ids array<long>")
    got = {}
    for x in vector.candidates(chunks, queries, 9, 0.0).collect():
        got.setdefault(x.query_id, []).append((-x.similarity, x.chunk_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i, (lo, hi, of, ids) in enumerate(ask * 2):
        ok = [j for j in range(n) if (lo is None or (year[j] or 0) >= lo) and (hi is None or (year[j] is not None and year[j] <= hi)) and (of is None or kind[j] == of) and (ids is None or j // 2 in ids)]
        s = {j: float(np.einsum("nd,nd->n", u[3 * i : 3 * i + 1], u[j : j + 1])[0]) for j in ok}
        want = sorted((-s[j], j) for j in ok if s[j] >= 0)[:9]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want], i


def test_similarity_distribution_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    monkeypatch.setattr(vector, "TILE_QUERIES", 3)
    r = np.random.default_rng(7)
    v = r.normal(size=(90, 6)).astype(np.float32).astype(float)
    v[30:60] = v[30]
    chunks = spark.createDataFrame([(i, i // 3, v[i].tolist()) for i in range(90)], "chunk_id long, publication_id long, embedding array<float>")
    queries = chunks.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "publication_id", "embedding")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = {f: [float(u[q] @ u[j]) for q in range(0, 90, 10) for j in range(90) if j != q and (q // 3 == j // 3) == f] for f in (True, False)}
    for x in vector.similarity_distribution(chunks, queries).collect():
        p = np.array(pairs[x.same_publication])
        assert (x.pairs, x.share_above) == (len(p), round(float((p >= 0.48).mean()), 6))
        assert np.allclose([x.median, x.p95, x.p99, x.greatest], [*np.percentile(p, [50, 95, 99]), p.max()], atol=1e-4)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_approximate_searches(spark, sf):
    folder = f"/root/testdata/{sf}"
    c = Corpus(spark, folder)
    exact = vector.vector_search(c.chunks, research.queries_of(c), 8, research.CELL_GATE)
    assert evaluate.recall(research.cluster_search(spark, folder), exact).first().recall >= 0.9
    assert evaluate.recall(research.lsh(spark, folder), vector.vector_search(c.chunks, research.queries_of(c))).first().recall >= 0.9


def test_cluster_keywords_by_hand(spark):
    assigned = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p3"), (2, "p1")], "topic_id int, publication_id string")
    keywords = spark.createDataFrame([("p1", "Both"), ("p1", "both"), ("p2", "one"), ("p3", "two"), ("p3", "also two"), ("p9", "none")], "publication_id string, keyword string")
    got = {(r.topic_id, r.rank): (r.keyword, r.weight) for r in topics.cluster_keywords(assigned, keywords, 2).collect()}
    lone = lambda own: round(1 / own * float(np.log1p(2.5 / 1)), 9)  # noqa: E731  five occurrences in two topics
    both = lambda own: round(1 / own * float(np.log1p(2.5 / 2)), 9)
    assert got == {(1, 1): ("one", lone(2)), (1, 2): ("both", both(2)), (2, 1): ("also two", lone(3)), (2, 2): ("two", lone(3))}
    assert topics.cluster_keywords(assigned.limit(0), keywords).collect() == []


def test_fingerprint_is_of_the_rows_alone(spark):
    rows = [(i % 50, f"t{i % 50}" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t string")
    one = evaluate.fingerprint(df, "x", ["k", "t"]).first()
    assert evaluate.fingerprint(df.orderBy(F.desc("t")).repartition(7), "x", ["k", "t"]).first() == one and one.rows == 200
    for other in (df.unionByName(df.limit(1)), df.withColumn("t", F.coalesce("t", F.lit("\\N"))), df.withColumn("t", F.coalesce("t", F.lit("")))):
        assert evaluate.fingerprint(other, "x", ["k", "t"]).first()[2:] != one[2:]
    now = spark.createDataFrame([("a", 1, "1", "1"), ("b", 2, "1", "1"), ("c", 3, "1", "1"), ("d", 4, "4", "4")], "table string, rows long, lane_a string, lane_b string")
    then = spark.createDataFrame([("a", 1, "1", "1"), ("b", 3, "1", "1"), ("c", 3, "1", "2"), ("e", 4, "4", "4")], now.schema)
    assert {tuple(r) for r in evaluate.fingerprint_changes(now, then).collect()} == {("b", "other_rows"), ("c", "other_content"), ("d", "new"), ("e", "missing")}


def test_generic_rows_and_notes(spark):
    rows = spark.createDataFrame([(1, None, "A", 3.5, "T", 0.1), (1, "2020", None, None, "T", 0.25), (1, None, "A", None, None, 1.0), (2, None, "B", 2.0, None, None)], "question_id long, period string, author_name string, expertise_score double, topic_name string, growth_score double")
    assert sorted((r.question_id, r.metric, r.claim, r.confidence) for r in evidence.from_analytics(rows).collect()) == [(1, "expertise_score", "A scores 3.5 in T (all-time)", 1.0), (1, "growth_score", "T grew by 0.25 (2020)", 1.0), (2, "expertise_score", "B scores 2.0 in a related topic (all-time)", 1.0)]
    notes = spark.createDataFrame([(1, 3, "b", "x"), (1, 1, "a", " "), (1, 2, "b", None), (1, 4, "a", "y"), (2, 1, None, None)], "question_id long, position int, ignored string, lineage string")
    sources = spark.createDataFrame([], "question_id long, position int, publication_id string, title string, year int, doi string, relevance double, provenance string")
    _, _, told = evidence.unify(evidence.from_analytics(rows), sources, notes)
    assert {r.question_id: (r.filters_ignored, r.lineage) for r in told.collect()} == {1: (["a", "b"], "x; y"), 2: ([], None)}


@pytest.mark.parametrize("gate", [None, 0.0, 0.5])
def test_tiles_send_what_can_be_among_the_best(spark, monkeypatch, gate):
    """Two passes: the same nearest rows, by brute force, with few more sent than are kept; conditions and years as areas too."""
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    monkeypatch.setattr(vector, "TILE_QUERIES", 3)
    monkeypatch.setattr(vector, "TILES", 8)
    monkeypatch.setattr(vector, "BOUND_FROM", 1)
    r = np.random.default_rng(8)
    n, keep = 400, 60
    v = r.normal(size=(n, 6)).astype(np.float32).astype(float)
    v[40:80] = v[40]  # ties
    chunks = spark.createDataFrame([(i, i // 2, v[i].tolist(), 2000 + i % 2) for i in range(n)] + [(900, 1, None, 2001), (901, 1, [0.0] * 6, 2001)], "chunk_id long, publication_id long, embedding array<float>, year int").repartition(4)
    ask = [None, 2001] * 5
    sent = []
    monkeypatch.setattr(vector, "ranked", lambda found, *a, of=vector.ranked: (sent.append(found.count()), of(found, *a))[1])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for conditions in (False, True):
        queries = spark.createDataFrame([(i, v[3 * i].tolist(), y) for i, y in enumerate(ask)], "query_id long, embedding array<float>, year_low int")
        got = {}
        for x in vector.candidates(chunks, queries if conditions else queries.drop("year_low"), keep, gate).collect():
            got.setdefault(x.query_id, []).append((-x.similarity, x.chunk_id))
        kept = 0
        for i, y in enumerate(ask):
            s = {j: float(np.einsum("nd,nd->n", u[3 * i : 3 * i + 1], u[j : j + 1])[0]) for j in range(n) if not conditions or y is None or 2000 + j % 2 >= y}
            want = sorted((-s[j], j) for j in s if gate is None or s[j] >= gate)[:keep]
            assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want], i
            kept += len(want)
        assert kept <= sent.pop() <= 1.5 * kept + 40 * len(ask)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_search_sends_no_more_chunks_than_publications_need(spark, monkeypatch, most):
    """The window of 100 chunks holds where a publication has many; where it has few, k times as many are looked at."""
    r = np.random.default_rng(most)
    v = r.normal(size=(240, 4)).astype(np.float32).astype(float)
    chunks = spark.createDataFrame([(i, i // most, v[i].tolist()) for i in range(240)] + [(900 + i, 7000, None) for i in range(50)], "chunk_id long, publication_id long, embedding array<float>")
    queries = chunks.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "embedding")
    asked = []
    monkeypatch.setattr(vector, "candidates", lambda c, q, keep, *a, of=vector.candidates: (asked.append(keep), of(c, q, keep, *a))[1])
    got = {(x.query_id, x["rank"]): (x.publication_id, x.chunk_id) for x in vector.vector_search(chunks, queries, 4, 0.0).collect()}
    assert asked == [min(100, 4 * most)]
    u, want = v / np.linalg.norm(v, axis=1, keepdims=True), {}
    for q in range(5):
        seen = {}
        for j in [j for j in np.lexsort((np.arange(240), -(u @ u[q]))) if u[j] @ u[q] >= 0][:100]:
            seen.setdefault(int(j) // most, int(j))
        want |= {(q, k): x for k, x in enumerate(list(seen.items())[:4], 1)}
    assert got == want
