"""answer_batch: its tables grow with the distinct questions and with what they ask for."""

import pandas as pd
import pytest

from lodestone.operators import entities, graph, topics, vector
from lodestone.plans import answer_batch as plan
from lodestone.sources.corpus import Corpus
from tests import golden
from tests.test_answer_batch import ASKED

MORE = ["Top 2 institutions by publications from 1996 to 1997", "top 4 most cited publications", "Who collaborates with {name}?", "list publications by {name}", None]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    golden.write(path)
    pd.DataFrame([(i, [1.0, float(i)], i % 2) for i in range(40)], columns=["vec_id", "embedding", "label"]).to_parquet(f"{path}/embeddings.parquet")
    pd.DataFrame([(i, "papers on blue bolts in 1997" if i in (4, 18, 19) else f"other words {i}") for i in range(40)], columns=["doc_id", "text"]).to_parquet(f"{path}/documents.parquet")
    c = Corpus(spark, path)
    terms = spark.createDataFrame([(1, "widgets", "widget"), (2, "fastening", "bolt")], "topic_id int, topic_name string, term string")
    a = topics.assign_topics(c.publications, c.keywords, terms)
    evolved = topics.evolution(topics.topic_years(c.publications, a, terms.select("topic_id", "topic_name"), 1995, 2001), 1995)
    return c, a, terms, evolved


def answered(spark, corpus, questions, lookups, monkeypatch):
    c, a, terms, evolved = corpus
    rows = {}

    def counted(df, label, write=plan.written):
        out = write(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(plan, "written", counted)
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    edges = (lambda nodes: graph.edges_of(c.author_lines, "publication_id", "author_id", nodes)) if lookups else graph.collaboration_edges(c.pub_author, "publication_id", "author_id")
    scores = topics.scored(topics.author_topics(c, a, 2000)) if lookups else topics.expertise(c, a, 2000)
    out = plan.answer_batch(c, asked, edges, evolved, terms, a, scores, vector.hashing_encoder(64), 64)
    got = {r.question_id: (r.route, r.status, r.answer) for r in out.collect()}
    monkeypatch.undo()
    return got, rows


def test_equal_questions_are_answered_once(spark, corpus, monkeypatch):
    name = '"' + corpus[0].authors.orderBy("author_id").first().author_name + '"'
    questions = [q and q.format(name=name) for q in ASKED + MORE]
    once, few = answered(spark, corpus, questions, False, monkeypatch)
    many, rows = answered(spark, corpus, questions * 20, True, monkeypatch)
    assert once[12][:2] == ("graph", "ok") and once[13][:2] == ("sql", "ok") and once[14] == ("vector", "not_found", None)
    assert len(many) == 20 * len(questions) and all(many[k] == once[k % len(questions)] for k in many)
    assert rows["evidence"] == few["evidence"] and rows["texts"] == len(questions)


def test_cut_before_names_and_titles_keeps_what_is_level(spark, corpus, monkeypatch):
    questions = ["Top 3 most productive authors since 1992", "top 3 most cited publications"]
    whole, _ = answered(spark, corpus, questions, True, monkeypatch)
    monkeypatch.setattr(plan, "LIMIT_MOST", 3)
    assert answered(spark, corpus, questions, True, monkeypatch)[0] == whole
    c = corpus[0]
    p = sorted(c.publications.collect(), key=lambda r: (-r.citation_count, r.title is None, r.title, r.publication_id))[:3]
    assert all(f"{r.title or 'Untitled'}, {r.year}" in whole[1][2] for r in p)


def test_edges_of_asked_nodes(spark):
    rows = [(g, f"i{k}") for g, ks in {"1": "012", "2": "01", "3": "0123", "4": "45", "10": "451", "6": "3"}.items() for k in ks] + [("2", "i0"), ("3", None), (None, "i0"), (None, "i1")]
    df = spark.createDataFrame(rows, "g string, i string")
    for least in (1, 2):
        every = [tuple(r) for r in graph.collaboration_edges(df, "g", "i", least).collect()]
        for asked in ([], ["i0"], ["i1", "i4"], ["i9"], ["i0", "i1", "i2", "i3", "i4", "i5"]):
            nodes = spark.createDataFrame([(n,) for n in asked], "node string")
            got = sorted(tuple(r) for r in graph.edges_of(df, "g", "i", nodes, least).collect())
            assert got == sorted(e for e in every if {e[0], e[1]} & set(asked))


def test_only_asked_pieces_and_matched_names_are_looked_up(spark, monkeypatch):
    rows = {}

    def counted(df, label, write=entities.written):
        rows[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(entities, "written", counted)
    authors = spark.createDataFrame([(f"a{i:02d}", f"red bolt {i:02d}", f"red bolt {i:02d}") for i in range(30)] + [("b", "xyzabc", "xyzabc")], "author_id string, author_name string, author_name_normalized string")
    links = spark.createDataFrame([("p1", "a07"), ("p1", "a07"), ("p2", "a07"), ("p1", "b")], "publication_id string, author_id string")
    got = entities.resolve_authors(spark.createDataFrame([(1, "bolt")], "ask_id int, name string"), authors, links).first()
    assert (got.status, got.matches, got.candidates[0]) == ("needs_clarification", 30, "a07|red bolt 07|2")
    assert rows["gram-index"] == 2 * 30 and rows["matches"] == 30


def test_some_publications_are_those_of_all(corpus):
    c = corpus[0]
    every = {r.publication_id: r for r in c.publications.collect()}
    some = sorted(every)[::3]
    ids = c.spark.createDataFrame([(i,) for i in [*some, some[0], "none", None]], "publication_id string")
    got = c.publications_of(ids)
    assert got.count() == len(some) and {r.publication_id: r for r in got.collect()} == {i: every[i] for i in some}
