"""answer_batch against plain loops over a small corpus."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, topics, vector
from lodestone.plans.answer_batch import answer_batch
from lodestone.sources.corpus import Corpus
from tests import golden

ASKED = ["average citations in 1996", "total funding before 1997", "Top 3 most productive authors in 1996", "list publications from 1996 to 1996", "how many in 1996",
         "emerging trends in widgets since 1999", "experts in bolts > 1999", "papers on blue bolts in 1997", "anything at all", "list publications by Nobody Here"]


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    golden.write(path)
    pd.DataFrame([(i, [1.0, float(i)], i % 2) for i in range(40)], columns=["vec_id", "embedding", "label"]).to_parquet(f"{path}/embeddings.parquet")
    pd.DataFrame([(i, "papers on blue bolts in 1997" if i in (4, 18, 19) else f"other words {i}") for i in range(40)], columns=["doc_id", "text"]).to_parquet(f"{path}/documents.parquet")
    c = Corpus(spark, path)
    terms = spark.createDataFrame([(1, "widgets", "widget"), (2, "fastening", "bolt")], "topic_id int, topic_name string, term string")
    names = terms.select("topic_id", "topic_name")
    a = topics.assign_topics(c.publications, c.keywords, terms)
    evolved = topics.evolution(topics.topic_years(c.publications, a, names, 1995, 2001), 1995)
    edges = graph.collaboration_edges(c.pub_author, "publication_id", "author_id")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "question_id int, question string")
    out = answer_batch(c, asked, edges, evolved, terms, a, topics.expertise(c, a, 2000), vector.hashing_encoder(64), 64)
    return c, evolved.collect(), {r.question_id: r for r in out.collect()}


def test_statuses(got):
    _, evolved, rows = got
    trend = any(r.topic_id == 1 and r.year >= 1999 and r.is_emerging for r in evolved)
    assert [rows[i].status for i in range(10)] == ["ok", "ok", "ok", "ok", "ok", "ok" if trend else "not_found", "ok", "ok", "not_found", "not_found"]


def test_relational_answers_follow_the_intent(got):
    c, _, rows = got
    p = {r.publication_id: r for r in c.publications.collect()}
    y = [r for r in p.values() if r.year == 1996]
    assert rows[0].answer == f"1. The average is {round(sum(r.citation_count for r in y) / len(y), 2)} citations"
    assert rows[1].answer == f"1. There are {sum(p[r.publication_id].year <= 1997 for r in c.funding.collect())} grants"
    counts = {}
    for r in c.pub_author.collect():
        if p[r.publication_id].year == 1996:
            counts[r.author_id] = counts.get(r.author_id, 0) + 1
    name = {r.author_id: r.author_name for r in c.authors.collect()}
    best = sorted(counts, key=lambda a: (-counts[a], name[a], a))[:3]
    assert sorted(x.split(". ", 1)[1] for x in rows[2].answer.split("\n\n")) == sorted(f"{name[a]} has {counts[a]} publications" for a in best)
    assert rows[3].answer.count("\n\n") + 1 == len({(r.title, r.year, r.doi) for r in y}) and rows[4].answer == f"1. There are {len(y)} publications"


def test_hybrid_and_vector_follow_topic_and_years(got):
    c, evolved, rows = got
    want = sorted((r for r in evolved if r.topic_id == 1 and r.year >= 1999 and r.is_emerging), key=lambda r: (-r.growth_score, -r.year))[:5]
    assert (rows[5].answer or "").count("widgets grew") == len(want) and "fastening" not in (rows[5].answer or "")
    assert rows[6].answer.count(" scores ") == 5
    year = {r.publication_id: (r.title, r.year, r.doi) for r in c.publications.filter(F.col("publication_id").isin("2", "9")).collect()}
    assert [k for k, v in year.items() if v[1] == 1997] == ["2", "9"] or year["2"][1] == 1997
    assert rows[7].answer.startswith(f"1. [{year['2'][0]}, 1997") and rows[8].answer is None
