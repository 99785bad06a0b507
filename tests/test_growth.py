"""Steps whose tables grow with the input, not with its pairs or with how often something is asked."""

from __future__ import annotations

import itertools
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from lodestone.operators import entities, evaluate, evidence, graph, relational, topics, vector
from lodestone.plans import research
from lodestone.sources import shared
from lodestone.sources.corpus import Corpus


def test_repeated_names_are_matched_once(spark, monkeypatch):
    rows = {}

    def counted(df, label, write=entities.written):
        rows[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(entities, "written", counted)
    authors = spark.createDataFrame([(f"a{i:02d}", f"red bolt {i:02d}", f"red bolt {i:02d}") for i in range(30)], "author_id string, author_name string, author_name_normalized string")
    links = spark.createDataFrame([("p1", "a07"), ("p2", "a07"), ("p1", "a03")], "publication_id string, author_id string")
    names = spark.createDataFrame([(k, "bolt" if k % 2 else "Red Bolt 04") for k in range(200)] + [(900, None), (901, "re"), (902, "none")], "ask_id int, name string")
    got = {r.ask_id: r for r in entities.resolve_authors(names, authors, links).collect()}
    assert len(got) == 203 and rows["name-matches"] == 31
    assert {(got[k].status, got[k].matches, got[k].candidates[0], got[k].candidates[1], len(got[k].candidates)) for k in range(1, 200, 2)} == {("needs_clarification", 30, "a07|red bolt 07|2", "a03|red bolt 03|1", 5)}
    assert {(got[k].status, got[k].entity_id) for k in range(0, 200, 2)} == {("resolved", "a04")}
    assert (got[900].status, got[901].status, got[902].status) == ("not_found", "skipped", "not_found")


def test_asks_of_a_country_meet_its_publications_in_lists(spark, monkeypatch):
    joined = []

    def counted(*args, join=relational.spread_join, **named):
        joined.append((out := join(*args, **named)).count())
        return out

    monkeypatch.setattr(relational, "spread_join", counted)
    c = SimpleNamespace(
        pub_author=spark.createDataFrame([("p1", "a")], "publication_id string, author_id string"),
        pub_institution=spark.createDataFrame([(f"p{k}", "i") for k in range(40)], "publication_id string, institution_id string"),
        institutions=spark.createDataFrame([("i", "Peru")], "institution_id string, country string"),
    )
    asks = spark.createDataFrame([(k, None, None, "PERU") for k in range(50)], "ask_id int, author_id string, institution_id string, country string")
    got = sorted(tuple(r) for r in relational.members(c, asks).collect())
    assert got == sorted((k, f"p{p}") for k in range(50) for p in range(40))
    assert sum(joined) == 40
    monkeypatch.setattr(relational, "ASKS_LISTED", 7)
    assert sorted(tuple(r) for r in relational.members(c, asks).collect()) == got


def test_components_by_links_of_items(spark):
    rows = [("g1", f"i{k:02d}") for k in range(30)] + [("g2", "i29"), ("g2", "j"), ("g3", "k"), ("g3", "l"), ("g3", "l"), ("g4", "alone"), ("g5", None), (None, "j"), (None, "k")]
    df = spark.createDataFrame(rows, "g string, i string")
    links, edges = graph.group_links(df, "g", "i"), graph.collaboration_edges(df, "g", "i")
    assert links.count() == 31 and edges.count() == 437
    assert sorted(map(tuple, graph.ranked_components(links).collect())) == sorted(map(tuple, graph.ranked_components(edges).collect()))
    assert graph.summary(edges, links).first() == graph.summary(edges).first() and graph.summary(edges).first().nodes == 33
    assert {r.node: r.root for r in graph.components(links).collect()}["l"] == "k"


def test_coauthors_by_pairs(spark):
    written = {"p1": "abc", "p2": "ab", "p3": "bd", "p4": "e"}
    about = {"p1": [1, 2], "p2": [2], "p3": [2, 3], "p4": [1]}
    pa_ = spark.createDataFrame([(p, x) for p, xs in written.items() for x in xs], "publication_id string, author_id string")
    assigned = spark.createDataFrame([(t, p) for p, ts in about.items() for t in ts], "topic_id int, publication_id string")
    want = {}
    for p, xs in written.items():
        for (x, y), t in itertools.product(itertools.permutations(xs, 2), about[p]):
            want.setdefault((x, t), set()).add(y)
    got = {(r.author_id, r.topic_id): r.network for r in topics.coauthors(assigned, pa_).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_small_and_large_numbers_of_a_claim_are_plain_digits(spark):
    values = [0.0005, -0.0001, 0.0, 0.25, 1.5, 12345678.5, 20000000.0, 100.0, -0.001]
    grown = spark.createDataFrame([(k, "t", x, 2000) for k, x in enumerate(values)], "question_id int, topic_name string, growth_score double, year int")
    said = [r.claim for r in evidence.from_trends(grown).orderBy("question_id").collect()]
    assert said == [f"t grew by {x} in 2000" for x in ("0.0005", "-0.0001", "0.0", "0.25", "1.5", "12345678.5", "20000000.0", "100.0", "-0.001")]


def test_turns_over_edges_shuffle_what_nodes_say_once(spark):
    pairs = [(f"{k:02}{a}", f"{k:02}{b}") for k in range(4) for a, b in itertools.combinations("abcd", 2)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "node_a string, node_b string, weight int")
    edges = edges.withColumn("via", edges.node_a).selectExpr("node_a", "node_b", "weight", "array(via) AS via")
    near, names = graph.numbered(edges)
    assert near.count() == 48 and names.count() == 16
    start = graph._sized(near.groupBy("node").agg({"weight": "sum"}).selectExpr("node", "node AS community", "CAST(`sum(weight)` AS DOUBLE) AS degree").join(names.withColumnRenamed("id", "node"), "node"))
    turn = graph._moved(near.selectExpr("node", "partner", "CAST(weight AS DOUBLE) AS weight"), start, 48.0, 1, 2)
    plan = turn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Exchange hashpartitioning(partner") == 1
    sums = turn.selectExpr("sum(within) AS within", "sum(square) AS square").first()
    assert (sums.within, sums.square) == (0.0, 16 * 9.0)


def test_grades_of_hits_and_counts_stand_for_all_relevant_pairs(spark):
    chunks = spark.createDataFrame([(k, k // 2, [1.0], k % 3 if k % 7 else None) for k in range(400)], "chunk_id long, publication_id long, embedding array<float>, label int")
    c = SimpleNamespace(chunks=chunks)
    hits = spark.createDataFrame([(20 * q, (10 * q + 3 * r) % 200, r + 1, 0.9 - 0.1 * r) for q in range(20) for r in range(6)], "query_id long, publication_id long, rank int, similarity double")
    q = chunks.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "publication_id AS own", "label AS own_label")
    every = q.join(chunks, (chunks.publication_id == q.own) | (chunks.label == q.own_label)).selectExpr("query_id", "publication_id", "CASE WHEN publication_id = own THEN 3 ELSE 1 END AS grade").groupBy("query_id", "publication_id").agg({"grade": "max"}).withColumnRenamed("max(grade)", "grade")
    few = research.relevance_of(c, hits)
    assert few.count() < 120 < every.count()
    asked = q.select("query_id")
    assert sorted(evaluate.query_metrics(hits, every, asked).collect()) == sorted(evaluate.query_metrics(hits, few, asked, ideal=research.ideal_of(c)).collect())
    gates = [0.2, 0.55, 0.8, 0.95]
    assert sorted(evaluate.sweep(hits, every, asked, gates).collect()) == sorted(evaluate.sweep(hits, few, asked, gates, ideal=research.ideal_of(c)).collect())


def test_tasks_of_edges_follow_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    df = spark.createDataFrame([(f"g{k}", f"i{k}{x}") for k in range(20) for x in range(8)], "g string, i string")
    edges = graph.collaboration_edges(df, "g", "i")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(node_a#\d+, node_b#\d+, (\d+)\)", plan) == ["12"]
    assert edges.count() == 20 * 28


def test_buckets_send_their_best_and_no_pairs(spark, monkeypatch):
    sent = []

    def counted(*args, cut=vector.tiles):
        sent.append((out := shared.written(cut(*args), "found")).count())
        return out

    monkeypatch.setattr(vector, "tiles", counted)
    # Groups of near copies: each query has 40 publications over the gate, of two chunks each.
    v = [[1.0 + (c % 7 == d) + (g == d) * 9 + c * d / 9e3 for d in range(5)] for g in range(5) for c in range(80)]
    chunks = spark.createDataFrame([(i, i // 2, x) for i, x in enumerate(v)] + [(900, 450, [0.0] * 5), (901, 450, None)], "chunk_id long, publication_id long, embedding array<float>")
    asked = chunks.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    want = {tuple(r) for r in vector.vector_search(chunks, asked, 3, 0.9).select("query_id", "chunk_id", "rank", "similarity").collect()}
    sent.clear()
    got = vector.lsh_search(chunks, asked, 3, 0.9, width=50.0, tables=2)
    assert {tuple(r) for r in got.select("query_id", "chunk_id", "rank", "similarity").collect()} == want and len(want) == 40 * 3
    assert len(sent) == 1 and 0 < sent[0] <= 40 * 3 * 2 * 2  # three publications for a query and a bucket; a table cuts directions once at most


def test_edges_of_a_least_weight_go_as_numbers(spark):
    def plain(names):
        shared_by = {}
        for g, items in names.items():
            for a, b in itertools.combinations(sorted(set(items)), 2):
                shared_by.setdefault((a, b), []).append(g)
        return shared_by

    def found(names, least):
        df = spark.createDataFrame([(g, i) for g, items in names.items() for i in items] + [(None, "9"), ("7", None)], "g string, i string")
        return df, {(r.node_a, r.node_b): (r.weight, r.via) for r in graph.collaboration_edges(df, "g", "i", least).collect()}

    numbers = {"10": ["9", "10", "100", "9"], "9": ["9", "10"], "100": ["100", "9", "-3"], "-1": ["7"]}
    words = numbers | {"x": ["9", "09"], "10": ["09", "9", "10", "+9", " 9"]}
    for names, whole in ((numbers, True), (words, False)):
        for least in (1, 2, 3):
            df, got = found(names, least)
            assert got == {e: (len(gs), sorted(gs)) for e, gs in plain(names).items() if len(gs) >= least}
        pairs, _, as_numbers = graph._pairs(df, "g", "i", numbers=True)
        assert as_numbers == whole and {t for _, t in pairs.dtypes} == ({"bigint"} if whole else {"string"})


def test_edges_are_made_once_for_both_ends(spark):
    edges = spark.createDataFrame([("a", "b", 2, ["p", "q"])], "node_a string, node_b string, weight int, via array<string>")
    out = graph.both_ways(edges)
    assert {tuple(r)[:3] for r in out.collect()} == {("a", "b", 2), ("b", "a", 2)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_once_and_repeats_fall_out(spark, monkeypatch):
    rows = {}

    def counted(df, label, write=topics.written):
        rows[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(topics, "written", counted)
    publications = spark.createDataFrame([("p1", "Red bolt"), ("p2", None), ("p3", "red")], "publication_id string, title string")
    keywords = spark.createDataFrame([("p1", "BOLT")] * 9 + [("p2", "ring")] * 9 + [("p3", None), ("p2", "gear")], "publication_id string, keyword string")
    terms = spark.createDataFrame([(1, "bolt"), (1, "ring"), (2, "red"), (3, "none")], "topic_id int, term string")
    got = sorted(tuple(r) for r in topics.assign_topics(publications, keywords, terms).collect())
    assert got == [(1, "p1"), (1, "p2"), (2, "p1"), (2, "p3")]
    assert rows == {"texts": 2 + 19, "matched": 5}


def test_years_need_no_titles(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    assert c.publications.drop("title").exceptAll(c.dated).isEmpty() and c.dated.count() == c.publications.count()
    assert "Join" not in c.dated._jdf.queryExecution().optimizedPlan().toString()
    lines = c.keyword_lines
    assert lines.distinct().exceptAll(c.keywords.drop("keyword_id")).isEmpty() and lines.count() > c.keywords.count()


def test_pairs_of_few_items_are_counted_before_the_shuffle(spark):
    df = spark.createDataFrame([(f"g{k % 40}", f"i{k % 7 if k % 3 else 9}") for k in range(400)] + [(None, "i1"), ("g1", None)], "g string, i string")
    out = graph.collaboration_counts(df, "g", "i")
    want = {(r.node_a, r.node_b, r.weight) for r in graph.collaboration_edges(df, "g", "i").collect()}
    assert {tuple(r) for r in out.collect()} == want and len(want) == 28
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "node_a" in plan.split("partial_count")[0] and "via" not in plan


def test_an_authors_publications_are_shuffled_once_and_no_pairs(spark, tmp_path, monkeypatch):
    from tests import golden

    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    golden.write(str(tmp_path))
    c = Corpus(spark, str(tmp_path))
    terms = spark.createDataFrame([(1, "widget"), (2, "promo"), (2, "bolt"), (3, "ring"), (4, "none")], "topic_id int, term string")
    a = topics.assign_topics(c.publications, c.keyword_lines, terms)
    network = topics.coauthors(a, c.pub_author.select("author_id", "publication_id"))
    keys = ["author_id", "topic_id", "matched", "citations", "recent", "h_index", "portfolio"]
    want = sorted((*(r[k] for k in keys), r.network or 0) for r in topics.author_topics(c, a, 1998).join(network, ["author_id", "topic_id"], "left").collect())
    assert len(want) > 12 and any(r[5] > 1 for r in want)
    for numbers in (True, False):
        assert sorted((*(r[k] for k in keys), r.network) for r in topics.networked(c, a, 1998, 3, numbers, [1, 2, 3, 4]).collect()) == want
    scores = topics.expertise(c, a, 1998)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "node_a" not in plan and plan.count("Exchange hashpartitioning(author_id") == 1
    monkeypatch.setattr(topics, "BITS", 2)
    assert sorted(map(tuple, topics.expertise(c, a, 1998).collect())) == sorted(map(tuple, scores.collect()))


def test_texts_are_made_once_for_both_assignments(spark, tmp_path, monkeypatch):
    """k5_cluster_expertise writes its texts once; a publication's keywords go through the shuffle as one list of numbers."""
    from tests import golden

    golden.write(str(tmp_path))
    labels = []
    monkeypatch.setattr(topics, "written", lambda df, label, of=topics.written: (labels.append(label), of(df, label))[1])
    assert research.cluster_expertise(spark, str(tmp_path)).count() and labels.count("texts") == 1
    assigned = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p1")], "topic_id int, publication_id string")
    keywords = spark.createDataFrame([("p1", "A"), ("p1", "a"), ("p2", "b"), ("p1", "c")], "publication_id string, keyword string")
    few = sorted(map(tuple, topics.cluster_keywords(assigned, keywords).collect()))
    monkeypatch.setattr(topics, "TERMS_MOST", 1)
    assert few == sorted(map(tuple, topics.cluster_keywords(assigned, keywords).collect())) and len(few) == 5
