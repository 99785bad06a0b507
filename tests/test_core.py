"""Golden cases and invariants of the research-corpus operators."""

import math
from collections import defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from lodestone.functions import columns as C
from lodestone.operators import conversation, entities, evaluate, evidence, graph, keys, quality, questions, relational, topics, vector
from lodestone.sources import tables
from lodestone.sources.corpus import Corpus
from tests import golden

EDGES = [("A", "B", 3, ["P1", "P2"]), ("B", "C", 1, ["P2"]), ("A", "C", 2, ["P3"]), ("C", "D", 1, ["P4"])]


def edge_table(spark, rows=EDGES):
    return spark.createDataFrame(rows, "node_a string, node_b string, weight int, via array<string>")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    golden.write(path)
    return Corpus(spark, path)


def test_golden_graph(spark):
    e = edge_table(spark)
    d = {r.node: (r.degree, r.weighted_degree, r.degree_centrality) for r in graph.degrees(e).collect()}
    assert {k: v[0] for k, v in d.items()} == {"A": 2, "B": 2, "C": 3, "D": 1} and d["A"][1] == 5 and d["C"][2] == 1.0
    assert {(r.node_a, r.node_b) for r in graph.top_subgraph(e, 2).collect()} == {("A", "C")}
    assert graph.summary(e).first().asDict() == {"nodes": 4, "edges": 4, "components": 1, "largest": 4, "average_degree": 2.0}
    with pytest.raises(ValueError):
        graph.top_subgraph(e, 0)
    isolated = graph.degrees(e, spark.createDataFrame([("A",), ("Z",)], "node string"))
    assert {r.node: r.degree for r in isolated.collect()} == {"A": 2, "Z": 0}


def test_paths_have_no_repeats_and_do_not_depend_on_order(spark):
    sources = spark.createDataFrame([("D",), ("A",)], "node string")
    got = sorted(tuple(r.path) for r in graph.paths(edge_table(spark), sources, 3).collect())
    again = sorted(tuple(r.path) for r in graph.paths(edge_table(spark, EDGES[::-1]).repartition(3), sources, 9).collect())
    assert got == again and all(len(set(p)) == len(p) for p in got)
    assert ("D", "C", "A") in got and ("D", "C", "B", "A") in got and max(map(len, got)) == 4
    assert {tuple(r.path) for r in graph.paths(edge_table(spark), sources, 3, target="B").collect()} == {p for p in got if p[-1] == "B"}


def test_edges_blocks_and_invariants(spark, monkeypatch):
    rows = [(g, f"i{i:02d}") for g in ("g1", "g2") for i in range(30)] + [("g3", "i00"), ("g3", "i01"), ("g4", "i05")]
    df = spark.createDataFrame(rows + rows[:5], "g string, i string")
    whole = sorted(map(tuple, graph.collaboration_edges(df, "g", "i").collect()))
    monkeypatch.setattr(graph, "PAIR_BLOCK", 7)
    assert sorted(map(tuple, graph.collaboration_edges(df, "g", "i").collect())) == whole
    assert len(whole) == 435 and all(a < b and w == len(v) for a, b, w, v in whole)
    assert whole[0] == ("i00", "i01", 3, ["g1", "g2", "g3"])


def test_normalize_edges(spark):
    raw = edge_table(spark, [("B", "A", 3, ["P2"]), ("A", "B", 5, ["P1", "P2"]), ("A", "A", 9, ["P1"]), ("C", "A", 1, ["P1"])])
    merged, report = graph.normalize_edges(raw, 2)
    assert [tuple(r) for r in merged.collect()] == [("A", "B", 5, ["P1", "P2"])]
    assert report.first().asDict() == {"rows": 4, "light": 1, "loops": 1}


def brute_betweenness(edges):
    near = defaultdict(set)
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    out = defaultdict(float)
    for s in near:
        dist, sigma, order, before, todo = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list), deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(near)
    return {v: round(out[v] / ((n - 1) * (n - 2)), 6) for v in near}


def test_betweenness_against_brute_force(spark):
    edges = EDGES + [("D", "E", 1, ["P"]), ("E", "F", 1, ["P"]), ("D", "F", 1, ["P"]), ("X", "Y", 1, ["P"]), ("F", "G", 1, ["P"])]
    got = {r.node: r.betweenness for r in graph.betweenness(edge_table(spark, edges)).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}", 1, ["P"]) for i in range(70)] + [("p", "q", 1, ["P"])]
    got = {r.node: (r.component, r["size"]) for r in graph.ranked_components(edge_table(spark, chain)).collect()}
    assert got["n000"] == got["n070"] == (1, 71) and got["p"] == got["q"] == (2, 2)


def test_communities_and_modularity(spark):
    two = [(a, b, 5, ["P"]) for g in ("abcd", "wxyz") for a, b in combinations(g, 2)] + [("d", "w", 1, ["P"])]
    labels = graph.communities(edge_table(spark, two))
    got = {r.node: r.community for r in labels.collect()}
    assert {got[x] for x in "abcd"} == {"a"} and {got[x] for x in "wxyz"} == {"w"}
    m, inside = 61, 60
    assert graph.modularity(edge_table(spark, two), labels).first().modularity == round(inside / m - 2 * (61 / (2 * m)) ** 2, 6)


def test_adapter_and_relational(corpus):
    p = corpus.publications
    assert p.count() == 40 and p.filter("title is null").count() == 2 and p.filter("doi is null").count() == 8
    pa_, counts = corpus.pub_author, {r.author_id: r.publication_count for r in relational.author_counts(corpus).collect()}
    for r in relational.top_authors(corpus, 99).collect():
        assert r.publication_count == counts[r.author_id] == pa_.filter(F.col("author_id") == r.author_id).select("publication_id").distinct().count()
    assert relational.average_citations(corpus, "eq", 1800).first().asDict() == {"avg_citations": 0.0, "total_publications": 0}
    assert relational.top_institutions(corpus, 99, country="asia").count() == 3
    assert abs(sum(r.share for r in relational.year_histogram(corpus).collect()) - 1) < 1e-5


def test_columns(spark):
    df = spark.createDataFrame([("50%_off \\ Sale", 2020, None, " T ", None)], "s string, y int, z int, t string, d string")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(C.icontains(F.col("s"), "%_OFF \\")) and not one(C.icontains(F.col("s"), "50__off"))
    assert one(C.normalize_text(F.lit(" Rahayu,  Yanti! "))) == "rahayu yanti"
    assert one(C.citation(F.col("t"), F.col("z"), F.col("d"))) == "[T, n.d., no-doi]" and one(C.citation(F.lit(" "), F.col("y"), F.lit("10.1/x"))) == "[Untitled, 2020, 10.1/x]"
    n = F.lit(None).cast("int")
    assert [one(C.period_label(*x)) for x in ((F.col("y"), n, n), (n, F.lit(1), F.lit(2)), (n, F.lit(1), n), (n, n, F.lit(2)), (n, n, n))] == ["2020", "1-2", "1-present", "up-to-2", "all-time"]
    assert [one(C.year_pred(F.col("y"), *x)) for x in ((None,), ("eq", 2020), ("gt", 2020), ("between", None, 2020, 2021))] == [True, True, False, True]
    assert one(C.ellipsis(F.lit("a  b" * 30), 10)) == "a ba ba b…" and one(C.session_title(F.lit(""))) == "New session"
    assert one(C.session_title(F.lit("word " * 30))) == "word " * 15 + "word"
    assert one(C.token_overlap(F.lit("a b c d"), F.lit("a b c e"))) == 0.6 and one(C.token_overlap(F.lit("a"), F.lit("a"))) == 1.0
    assert one(C.json_array(F.lit('{"a": 1}'), "array<struct<a:int>>")) == [] and one(C.json_array(F.lit("broken"), "array<int>")) == [] and one(C.json_array(F.lit("[1, 2]"), "array<int>")) == [1, 2]
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(C.cosine(v, v)) == 1.0 and one(C.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(C.valid_vector(v, 2)) and not one(C.valid_vector(F.array(F.lit(float("nan")), F.lit(1.0)), 2)) and not one(C.valid_vector(v, 3))
    assert one(C.tidy(F.lit("Claim  , more ( ) ."))) == "Claim, more."


def test_topics_and_expertise(spark, corpus):
    terms = spark.createDataFrame([(1, "w", "WIDGET"), (2, "e", "economy"), (3, "none", "zzz")], "topic_id int, topic_name string, term string")
    a = topics.assign_topics(corpus.publications, corpus.keywords, terms)
    names = terms.select("topic_id", "topic_name")
    totals = {r.topic_id: r.total_publications for r in topics.topic_totals(corpus.publications, a, names).collect()}
    years = topics.topic_years(corpus.publications, a, names, 1995, 2001)
    assert years.count() == 21 and totals[3] == 0 and {r.topic_id: r.n for r in years.groupBy("topic_id").agg(F.sum("publication_count").alias("n")).collect()} == totals
    scores = topics.expertise(corpus, a, 2000)
    for c in ("expertise_score", "relevance_score", "productivity_score", "impact_score", "recency_score"):
        assert scores.filter(f"{c} < 0 OR {c} > 100 OR {c} IS NULL").isEmpty()
    series = spark.createDataFrame([(1, 2000 + i, n, 0) for i, n in enumerate([0, 2, 3, 0, 0])], "topic_id int, year int, publication_count long, citation_count long")
    got = [(r.growth_score, r.citation_acceleration, r.is_emerging) for r in topics.evolution(series, 2000).orderBy("year").collect()]
    assert got == [(0.0, 0.0, False), (0.25, 0.25, True), (0.5, 0.25, True), (-1.0, -1.5, False), (0.0, 1.0, False)]
    h = topics.h_index(spark.createDataFrame([("a", c) for c in (10, 8, 5, 4, 3)] + [("b", 0)], "g string, c int"), ["g"], "c")
    assert {r.g: r.h_index for r in h.collect()} == {"a": 4, "b": 0}


def test_vector_search(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(300, 16))
    chunks = spark.createDataFrame([(i, i // 2, v[i].tolist(), i % 4) for i in range(300)] + [(999, 400, None, 0)], "chunk_id long, publication_id long, embedding array<float>, label int").repartition(5)
    queries = chunks.filter("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "publication_id", "embedding")
    got = vector.vector_search(chunks, queries, k=5, threshold=0.2).collect()
    f = v.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    for q in range(12):
        s = f @ f[q]
        best = {}
        for i in np.lexsort((np.arange(300), -s))[: vector.window_size(5)]:
            if s[i] >= 0.2:
                best.setdefault(i // 2, i)
        assert [x.chunk_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == list(best.values())[:5]
    for g in (0.1, 0.4):
        open_ = vector.vector_search(chunks, queries, k=50, threshold=0.0).filter(F.col("similarity") >= g).filter("rank <= 5").select("query_id", "publication_id")
        direct = vector.vector_search(chunks, queries, k=5, threshold=g).filter(F.round("similarity", 4) >= g).select("query_id", "publication_id")
        assert open_.exceptAll(direct).isEmpty()
    exact = vector.vector_search(chunks, queries, k=3, threshold=0.3)
    assert evaluate.recall(vector.lsh_search(chunks, queries, k=3, threshold=0.3, width=2.0, tables=12), exact).first().recall >= 0.9
    with pytest.raises(ValueError):
        vector.vector_search(chunks, queries, k=51)
    centers = {x.grp: x.centroid for x in vector.centroids(chunks, "label").collect()}
    m = f.astype(float)
    want = np.mean(v.astype(np.float32)[np.arange(300) % 4 == 1].astype(float), axis=0)
    assert np.allclose(centers[1], want / np.linalg.norm(want), atol=1e-7) and m.shape == (300, 16)
    assert {x.verdict for x in vector.diagnostics(chunks, queries, threshold=0.999).collect()} == {"hit"}


def test_embedding_jobs(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "chunk_id long, chunk_text string")
    done = vector.embed_chunks(chunks, vector.hashing_encoder(4), "m", "1", 4)
    assert done.filter("valid").count() == 3 and vector.embed_chunks(chunks, vector.hashing_encoder(4), "m", "1", 5).filter("valid").isEmpty()
    assert [r.chunk_id for r in vector.pending(chunks, done.filter("chunk_id = 1")).orderBy("chunk_id").collect()] == [2, 3]
    assert vector.pending(chunks, done, force=True, limit=2).count() == 2
    assert vector.mixed_versions(done, "m", "2").count() == 1 and vector.mixed_versions(done, "m", "1").isEmpty()


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, " ", False)], "query_id int, query string, has_answer boolean")
    hits = spark.createDataFrame([(1, "p1", 1, 0.9), (1, "p2", 2, 0.5), (2, "p9", 1, 0.4)], "query_id int, publication_id string, rank int, similarity double")
    rel = spark.createDataFrame([(1, "p2", 3), (1, "p3", 1), (2, "p1", 2)], "query_id int, publication_id string, grade int")
    m = {r.query_id: r for r in evaluate.query_metrics(hits, rel, q, 8).collect()}
    ndcg = (3 / math.log2(3)) / (3 + 1 / math.log2(3))
    assert (m[1].precision, m[1].recall, m[1].mrr, m[1].hit) == (0.125, 0.5, 0.5, 1) and abs(m[1].ndcg - ndcg) < 1e-6
    assert (m[2].ndcg, m[2].mrr, m[3].recall) == (0.0, 0.0, 0.0)
    swept = {r.threshold: r.hit for r in evaluate.sweep(hits, rel, q, [0.3, 0.6], 8).collect()}
    assert swept == {0.3: round(1 / 3, 4), 0.6: 0.0}
    pts = spark.createDataFrame([(0.3, 0.90, 0.1), (0.4, 0.85, 0.0), (0.5, 0.84, 0.0), (0.6, 0.5, 0.0)], "threshold double, ndcg double, false_positive_rate double")
    assert evaluate.select_threshold(pts).first().threshold == 0.5 and evaluate.select_threshold(pts.filter("threshold = 0.3")).first().threshold is None
    bad = {(r.rule, r.query_id) for r in evaluate.validate_benchmark(q, rel.unionByName(spark.createDataFrame([(3, "p", 1), (7, "p", 1)], rel.schema))).collect()}
    assert bad == {("blank_query", 3), ("negative_with_grade", 3), ("unknown_query", 7)}
    floors = spark.createDataFrame([("ndcg", 0.8), ("mrr", 0.1)], "metric string, value double")
    assert [r.metric for r in evaluate.regressions(spark.createDataFrame([("ndcg", 0.7), ("mrr", 0.5)], "metric string, value double"), floors).collect()] == ["ndcg"]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "One [A study of things, 2020, 10.1/a] two [A study of things, 2021, 10.1/a]."), (2, "None."), (3, "X [Short, n.d., no-doi], y [Other title, 2000, 10.1/zz]")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, "A Study of Things", 2020, "10.1/A"), (3, "short!", None, None), (3, "Other title", 2000, "10.1/y")], "answer_id int, title string, year int, doi string")
    checked, texts = evidence.verify_citations(answers, sources)
    got = {(r.answer_id, r.place): r.verified for r in checked.collect()}
    assert got == {(1, 0): True, (1, 1): False, (3, 0): True, (3, 1): False}
    t = {r.answer_id: r.text for r in texts.collect()}
    assert t == {1: "One [A study of things, 2020, 10.1/a] two.", 2: "None.", 3: "X [Short, n.d., no-doi], y"}


def test_evidence_merging_and_ranking(spark):
    items = spark.createDataFrame([(1, "t", "s", "long content", 0.5, 0.9, ["a"], {"k": "1"}, 1), (1, "t", "s", "short", 0.7, 0.2, ["b", "a"], {"k": "2", "m": "3"}, 2)], "question_id int, source_type string, source_id string, content string, score double, confidence double, provenance_ids array<string>, metadata map<string,string>, position int")
    r = evidence.merge_items(items).first()
    assert (r.content, r.score, r.confidence, r.provenance_ids, r.metadata) == ("long content", 0.7, 0.9, ["a", "b"], {"k": "1", "m": "3"})
    counts = spark.createDataFrame([(1, 5), (2, 0)], "question_id int, total int")
    rows = evidence.from_count(counts, "total")
    assert [(x.question_id, x.claim, x.value_num) for x in rows.collect()] == [(1, "There are 5 publications", 5.0)]
    assert {x.question_id: x.zero_evidence_class for x in evidence.zero_class(counts, "total").collect()} == {1: None, 2: "zero_aggregate"}
    more = rows.unionByName(rows.withColumn("claim", F.lit("A")).withColumn("value_num", F.lit(9.0)))
    for df in (more, more.repartition(3)):
        assert [x.claim for x in evidence.rank_evidence(df).orderBy("rank").collect()] == ["A", "There are 5 publications"]


PHRASES = [
    ("How many publications were there in 2020?", "sql", "count", ("eq", 2020, 2020), 10),
    ("Top 5 most productive authors after 2019", "sql", "top_authors", ("gte", 2019, None), 5),
    ("average citations between 2022 and 2018", "sql", "average_citations", ("between", 2018, 2022), 10),
    ("Show 7 most cited articles before 2015", "sql", "most_cited", ("lte", None, 2015), 7),
    ("total grants > 2010", "sql", "funding", ("gt", 2010, None), 10),
    ("Who are the collaborators of Dina?", "graph", None, (None, None, None), 10),
    ("emerging trends since 1850", "hybrid", None, (None, None, None), 10),
    ("what is known about soil", "vector", None, (None, None, None), 10),
    ("hello", "vector", None, (None, None, None), 10),
]


def test_questions(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "question_id int, question string")
    for r in questions.read(df).collect():
        _, route, intent, years, limit = PHRASES[r.question_id]
        assert (r.route, r.intent, (r.year_op, r.year_from, r.year_to), r.requested_limit) == (route, intent, years, limit), r.question
    names = questions.names(spark.createDataFrame([("papers by Yanti Rahayu at \"Udayana Uni\"",), ("by nobody",)], "question string")).collect()
    assert [(r.author_name, r.institution_name) for r in names] == [("Yanti Rahayu", "Udayana Uni"), (None, None)]
    folded = questions.fold_years(questions.years(df.filter("question_id IN (0, 2, 4)")).withColumns({c: F.lit(None).cast("int") for c in ("filter_year", "filter_from", "filter_to")}))
    assert {r.question_id: (r.filter_year, r.filter_from, r.filter_to, r.dropped_op) for r in folded.collect()} == {0: (2020, None, None, None), 2: (None, 2018, 2022, None), 4: (None, None, None, "gt")}


def test_entities(spark):
    authors = spark.createDataFrame([("1", "Rahayu, Yanti", "rahayu, yanti"), ("2", "Sari, Dewi", "sari, dewi"), ("3", "Sari, Dewi K", "sari, dewi k"), ("4", "100% Sure", "100% sure")], "author_id string, author_name string, author_name_normalized string")
    links = spark.createDataFrame([("2", "p1"), ("3", "p1"), ("3", "p2")], "author_id string, publication_id string")
    names = spark.createDataFrame([(1, "rahayu yanti"), (2, "sari"), (3, "Sari, Dewi"), (4, "zz"), (5, "nobody"), (6, "0% s")], "ask_id int, name string")
    got = {r.ask_id: (r.status, r.entity_id) for r in entities.resolve_authors(names, authors, links).collect()}
    assert got == {1: ("resolved", "1"), 2: ("needs_clarification", None), 3: ("resolved", "2"), 4: ("skipped", None), 5: ("not_found", None), 6: ("resolved", "4")}
    places = authors.toDF("institution_id", "institution_name", "institution_name_normalized")
    narrowed = {r.ask_id: (r.status, r.entity_id, r.narrowed) for r in entities.resolve_institutions(names, places, links.toDF("institution_id", "publication_id")).collect()}
    assert narrowed[2] == ("resolved", "3", True)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", -1), (None, "c", 2)], "k int, s string, n int")
    assert {(r.k, r.rows) for r in quality.key_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    assert [(r.rule, r.key) for r in quality.range_violations(df, "s", {"n": F.col("n") >= 0}).collect()] == [("n", "b")]
    want = StructType([StructField("k", StringType()), StructField("x", IntegerType())])
    assert {(r.column, r.level) for r in quality.schema_audit(df, want, "t").collect()} == {("x", "error"), ("k", "warning"), ("s", "note"), ("n", "note")}
    assert [r.column for r in quality.fenced_columns(df, ["^n$"], "t").collect()] == ["n"]
    bad = quality.edge_violations(edge_table(spark, [("B", "A", 1, ["P"]), ("A", "C", 2, ["P"]), ("A", "D", 0, [])]), spark.createDataFrame([("A",), ("B",), ("D",)], "node string"))
    assert {(r.rule, r.key) for r in bad.collect()} == {("order", "B-A"), ("weight", "A-C"), ("unknown_end", "A-C"), ("provenance", "A-D")}
    good, held = quality.quarantine(df, ["k"])
    assert good.count() == 2 and held.first().reason == "no k"
    out, report = quality.backfill_column(df.filter("k is not null").dropDuplicates(["k"]), spark.createDataFrame([(1, None), (9, "z")], "k int, s string"), "k", "s")
    assert out.first().s is None and report.first().asDict() == {"updated": 1, "orphans": 1, "nulls": 1, "non_blank": 1} and not quality.backfill_accepted(report).first().accepted


def test_duplicates_join_over_tiers(spark):
    df = spark.createDataFrame([("1", "D1", None, "t", 1), ("2", "d1", "E1", None, 5), ("3", None, "E1", "t", 2), ("4", None, None, "other", 9)], "id string, doi string, eid string, title string, cited int")
    groups = quality.duplicate_groups(df, "id", {"doi": F.lower("doi"), "eid": F.col("eid"), "title": F.lower("title")})
    assert {r.key: r.group_key for r in groups.collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}
    m = {r.group_key: r for r in quality.merge_duplicates(df, groups, "id", ["doi", "eid", "title"], ["cited"]).collect()}
    assert (m["1"].records, m["1"].cited, m["1"].eid, m["1"].title) == (3, 5, "E1", "t")


def test_surrogate_key_is_dense(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(6)
    assert sorted((r.row_id, r.v) for r in keys.add_surrogate_key(df, ["v"]).collect()) == [(i + 1, i) for i in range(101)]


def test_conversations(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"message {i}", "sql" if i % 2 else None, "x" if i == 0 else None, None) for i in range(7)] + [(2, 0, "assistant", "hi", "graph", None, "t")], "session_id int, seq int, role string, content string, route string, country string, topic_name string").withColumn("created_at", F.timestamp_seconds(F.col("seq") * 60))
    s = {r.session_id: r for r in conversation.sessions(m).collect()}
    assert (s[1].message_count, s[1].title, s[1].last_route) == (7, "message 0", "sql") and s[2].title == "New session"
    assert [(r.seq, r.position) for r in conversation.recent(m, 3).filter("session_id = 1").orderBy("position").collect()] == [(4, 1), (5, 2), (6, 3)]
    e = conversation.effective_filters(conversation.scope(m))
    assert {r.seq: (r.effective_country, r.inherited) for r in e.filter("session_id = 1").collect()}[5] == ("x", ["country"])
    text = {r.session_id: r for r in conversation.summaries(m, earlier=2).collect()}
    assert text[1].summary == "Latest: message 6\nScope: country=x\nEarlier: message 4 | message 2" and text[1].messages_covered == 7
    assert {r.session_id: r.block for r in conversation.block(m, 2).collect()}[1] == "Assistant: message 5\nUser: message 6"
    stored = spark.createDataFrame([(1, 3), (2, 1)], "session_id int, messages_covered int")
    assert [r.session_id for r in conversation.stale(stored, m).collect()] == [1]
    fresh = conversation.upsert_summaries(stored, spark.createDataFrame([(1, 7), (5, 1)], stored.schema))
    assert {(r.session_id, r.messages_covered) for r in fresh.collect()} == {(1, 7), (2, 1), (5, 1)}


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿id,name,n,day\n1,"two\nlines, ""quoted""",5,2020-01-02\n2,,x,bad\n'.encode())
    schema = StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("n", IntegerType()), StructField("day", DateType()), StructField("gone", StringType())])
    rows = tables.read_silver_csv(spark, str(path), schema).orderBy("id").collect()
    assert rows[0].name == 'two\nlines, "quoted"' and rows[0].n == 5 and str(rows[0].day) == "2020-01-02" and rows[0].gone is None
    assert rows[1].name is None and rows[1].n is None and rows[1].day is None
    out = f"file://{tmp_path}/table"
    df = spark.range(5).toDF("k")
    assert tables.materialize(df, out).count() == 5 and tables.materialize(df.limit(3), out).count() == 3
    with pytest.raises(ValueError):
        tables.materialize(df, out, lambda t: t.filter("k > 3"))
    assert spark.read.parquet(out).count() == 3
    tables.append_missing(df, out, "k")
    tables.append_missing(df, out, "k")
    assert spark.read.parquet(out).count() == 5
    tables.write_edges_csv(edge_table(spark), f"{out}-edges")
    assert "P1;P2" in {r.via for r in spark.read.option("header", True).csv(f"{out}-edges").collect()}
    d = graph.degrees(edge_table(spark))
    tables.write_metrics_csv(d, f"{out}-m", d.orderBy(F.desc("degree"), "node").limit(1))
    assert {r.node for r in spark.read.option("header", True).csv(f"{out}-m").filter("in_top_n = 'true'").collect()} == {"C"}
    tables.write_report(d, f"{out}-r")
    assert spark.read.json(f"{out}-r").count() == 4


def test_stream_of_new_files(spark, tmp_path):
    from lodestone.streaming.incremental import run_available

    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, chunk_text string")

    def work(df):
        return vector.embed_chunks(df, vector.hashing_encoder(4), "m", "1", 4)

    first.write.parquet(source)
    assert run_available(spark, source, first.schema, work, out, "chunk_id", check) == 1
    assert run_available(spark, source, first.schema, work, out, "chunk_id", check) == 0
    spark.createDataFrame([(2, "again"), (3, "c")], first.schema).write.mode("append").parquet(source)
    run_available(spark, source, first.schema, work, out, "chunk_id", check)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_clusters_and_context(spark):
    chunks = spark.createDataFrame([(i, f"p{i}", [float(i % 2) * 10 + i / 100, 1.0]) for i in range(20)] + [(99, "p99", None)], "chunk_id long, publication_id string, embedding array<float>")
    words = spark.createDataFrame([(f"p{i}", f"w{i % 2}") for i in range(20)], "publication_id string, keyword string")
    found, top = topics.cluster_chunks(chunks, words, 2)
    assert found.count() == 20 and sorted(r.n for r in top.collect()) == [10, 10]
    s = spark.createDataFrame([(1, "p1", "T", 2000, "10.1/x", 0.5, "sql"), (1, "p2", None, None, None, None, "graph")], "question_id int, publication_id string, title string, year int, doi string, relevance double, provenance string")
    assert evidence.context_block(evidence.rank_sources(s)).first().context == "[1] [T, 2000, 10.1/x] | score 0.5000 | from sql\n[2] [Untitled, n.d., no-doi] | score 0.0000 | from graph"
