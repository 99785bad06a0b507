"""Memberships of publications, stamps of embeddings, years folded into filters, evidence from rows: by hand."""

from __future__ import annotations

import random
from types import SimpleNamespace

from lodestone.operators import evidence, quality, questions, relational, spread

ASKS = "ask_id int, author_id string, institution_id string, country string"


def corpus(spark, authors, places, countries):
    return SimpleNamespace(
        pub_author=spark.createDataFrame(authors, "publication_id string, author_id string"),
        pub_institution=spark.createDataFrame(places, "publication_id string, institution_id string"),
        institutions=spark.createDataFrame(countries, "institution_id string, country string"),
    )


def test_every_membership_that_is_set_must_hold(spark):
    c = corpus(spark, [("p1", "a"), ("p2", "a"), ("p2", "a"), ("p3", "b"), (None, "a")], [("p1", "i"), ("p2", "j"), ("p3", "i"), ("p3", "j")], [("i", "Peru"), ("j", "CHAD"), ("k", None)])
    asks = [(1, "a", None, None), (2, "a", "i", None), (3, None, "j", "peru"), (4, None, None, "chad"), (5, "a", "j", "Chad"), (6, "a", "j", "Peru"), (7, None, None, None), (8, "nobody", "i", None), (4, None, None, "Chad")]
    got = sorted((r.ask_id, r.publication_id or "") for r in relational.members(c, spark.createDataFrame(asks, ASKS)).collect())
    assert got == [(1, ""), (1, "p1"), (1, "p2"), (2, "p1"), (3, "p3"), (4, "p2"), (4, "p3"), (5, "p2")]
    assert relational.members(c, spark.createDataFrame([], ASKS)).collect() == []


def test_members_against_sets_with_a_hot_country(spark, monkeypatch):
    monkeypatch.setattr(spread, "PIECE", 8)
    r = random.Random(3)
    authors = {(f"p{r.randrange(120)}", f"a{r.randrange(9)}") for _ in range(300)}
    places = {(f"p{r.randrange(120)}", f"i{r.randrange(12)}") for _ in range(300)}
    country = {f"i{k}": "one" if k < 10 else "two" for k in range(12)}
    pick = lambda xs: r.choice([*xs, None, None])
    asks = [(k, pick([f"a{x}" for x in range(9)]), pick([f"i{x}" for x in range(12)]), pick(["One", "TWO"])) for k in range(60)]
    got = relational.members(corpus(spark, list(authors), list(places), list(country.items())), spark.createDataFrame(asks, ASKS)).collect()
    want = set()
    for k, a, i, n in asks:
        sets = []
        if a:
            sets.append({p for p, x in authors if x == a})
        if i:
            sets.append({p for p, x in places if x == i})
        if n:
            sets.append({p for p, x in places if country[x] == n.lower()})
        want |= {(k, p) for p in set.intersection(*sets)} if sets else set()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_embedding_versions(spark):
    schema = "embedding_model string, embedding_version string, embedding_dimension int"
    mixed = quality.embedding_versions(spark.createDataFrame([("m", "1", 4), ("m", "1", 4), (None, None, None)], schema)).collect()
    assert {(r.embedding_model, r.chunks, r.single) for r in mixed} == {("m", 2, False), (None, 1, False)}
    one = quality.embedding_versions(spark.createDataFrame([("m", "1", 4)] * 3, schema)).collect()
    assert [(r.chunks, r.single) for r in one] == [(3, True)]
    assert quality.embedding_versions(spark.createDataFrame([], schema)).collect() == []


def test_years_given_are_not_overwritten(spark):
    asked = [("papers in 2004", None, None, None), ("after 2004", None, None, None), ("before 2004", None, None, None), ("between 2009 and 2004", None, None, None), ("papers > 2004", None, None, None), ("papers in 2004", 1999, None, None), ("after 2004", None, None, 2001), ("no year", None, None, None)]
    df = questions.years(spark.createDataFrame(asked, "question string, filter_year int, filter_from int, filter_to int"))
    got = [(r.filter_year, r.filter_from, r.filter_to, r.dropped_op) for r in questions.fold_years(df).collect()]
    assert got == [(2004, None, None, None), (None, 2004, None, None), (None, None, 2004, None), (None, 2004, 2009, None), (None, None, None, "gt"), (1999, None, None, None), (None, None, 2001, None), (None, None, None, None)]


def test_a_count_of_zero_is_no_evidence(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "question_id string, n long")
    assert [(r.question_id, r.claim, r.value_num) for r in evidence.from_count(counts, "n").collect()] == [("a", "There are 3 publications", 3.0)]
    assert {r.question_id: r.zero_evidence_class for r in evidence.zero_class(counts, "n").collect()} == {"a": None, "b": "zero_aggregate", "c": "zero_aggregate"}
