"""Answers to a whole table of questions: read, resolve, retrieve by route, one evidence table, ranked."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import entities, evidence, graph, questions, vector
from lodestone.operators.topics import few
from lodestone.sources.corpus import Corpus
from lodestone.sources.shared import written


#: Most results that a question can ask for; the limits that questions state are held to it (see request_limit).
LIMIT_MOST = 50


def _top(df: DataFrame, keys: list[str], order: list, n: int | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= (F.col(n) if isinstance(n, str) else n)).drop("r")


def _relational(c: Corpus, sql: DataFrame) -> DataFrame:
    """Evidence by intent within the author and the years; questions without an intent are counts.

    What no question asks for is not made. Publications are counted and ranked without their titles, which are looked
    up where they break ties and for what is shown.
    """
    sql = sql.withColumn("intent", F.coalesce("intent", F.lit("count")))
    kinds = {(r.intent, r.everyone) for r in sql.select("intent", (F.col("author") == "").alias("everyone")).distinct().collect()}  # two for each intent at most
    pubs = c.dated.select("publication_id", "year", "citation_count")
    keys = ["author", "lo", "hi"]

    def scoped(*intents: str) -> DataFrame | None:
        """Publications of the authors that questions of these intents name (author '' for all of them), None without such questions."""
        out = pubs.withColumn("author", F.lit("")) if any((i, True) in kinds for i in intents) else None
        if any((i, False) in kinds for i in intents):
            asked = of(*intents).select("author").distinct()
            own = c.author_lines.select("publication_id", F.col("author_id").alias("author")).join(asked, "author", "left_semi").distinct()
            own = own.join(pubs, "publication_id").select("publication_id", "year", "citation_count", "author")
            out = own if out is None else out.unionByName(own)
        return out

    def within(by_year: DataFrame, some: DataFrame) -> DataFrame:
        return some.select(*keys).distinct().join(by_year, "author").filter(F.col("year").between(F.col("lo"), F.col("hi")))

    def tied(df: DataFrame, by: list[str], order) -> DataFrame:
        """The first LIMIT_MOST of each group, and those that are level with the last of them."""
        return df.withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("r") <= LIMIT_MOST).drop("r")

    of = lambda *names: sql.filter(F.col("intent").isin(*names))
    counted, mean, funded, listed = of("count"), of("average_citations"), of("funding"), of("list", "most_cited")
    out = evidence.from_count(sql.select("question_id", F.lit(0).alias("total")), "total")  # none
    some = scoped("count", "average_citations")
    if some is not None:
        n = some.groupBy("author", "year").agg(F.count(F.lit(1)).alias("n"), F.count("citation_count").alias("known"), F.sum("citation_count").alias("cited"))
        n = written(n, "years")
        out = out.unionByName(evidence.from_count(counted.join(within(n, counted).groupBy(*keys).agg(F.sum("n").alias("total")), keys), "total"))
        means = within(n, mean).groupBy(*keys).agg(F.round(F.try_divide(F.sum("cited"), F.sum("known")), 2).alias("mean")).filter("mean is not null")
        m = mean.join(means, keys)
        out = out.unionByName(evidence.evidence(m, F.col("question_id"), F.format_string("The average is %s citations", F.col("mean").cast("string")), "average_citations", F.col("mean")))
    some = scoped("funding")
    if some is not None:
        g = some.join(c.funding.select("publication_id", "funding_id"), "publication_id").groupBy("author", "year").agg(F.countDistinct("funding_id").alias("n"))
        g = written(g, "grants")
        out = out.unionByName(evidence.from_count(funded.join(within(g, funded).groupBy(*keys).agg(F.sum("n").alias("total")), keys), "total", "grants"))
    for intent, links, names, key, name in (("top_authors", c.author_lines, c.authors, "author_id", "author_name"), ("top_institutions", c.institution_lines, c.institutions, "institution_id", "institution_name")):
        some = scoped(intent)
        if some is None:
            continue
        top = of(intent)
        linked = links.repartition("publication_id").distinct()  # repeats lie together
        by = some.select("author", "year", "publication_id").join(linked, "publication_id").groupBy("author", "year", key).agg(F.count(F.lit(1)).alias("n"))
        ranked = within(by.repartition("author", key), top).groupBy(*keys, key).agg(F.sum("n").alias("n"))
        ranked = written(tied(ranked, keys, F.desc("n")), "ranked").join(names.select(key, name), key)
        ranked = _top(ranked, keys, [F.desc("n"), name, key], LIMIT_MOST)
        ranked = _top(top.join(ranked, keys), ["question_id"], [F.desc("n"), name, key], "requested_limit")
        out = out.unionByName(evidence.from_ranking(ranked, name, "n", "publications"))
    some = scoped("list", "most_cited")
    if some is None:
        return out
    order = [F.desc_nulls_last("citation_count"), F.asc_nulls_last("title"), "publication_id"]
    best = within(tied(some, ["author", "year"], order[0]), listed)  # the best of a range are among the best of its years
    best = written(tied(best, keys, order[0]).select(*keys, "publication_id"), "best")
    best = _top(best.join(c.publications_of(best), "publication_id"), keys, order, LIMIT_MOST)
    return out.unionByName(evidence.from_publications(_top(listed.join(best, keys), ["question_id"], order, "requested_limit")))


def _hybrid(c: Corpus, asked: DataFrame, evolved: DataFrame, terms: DataFrame, assigned: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Trends and experts of the topics whose terms the question has (of all topics without one), within its years."""
    kinds = asked.select("question", "lo", "hi", "hybrid_kind", "emerging_only").distinct()
    names = terms.select("topic_id", "topic_name").distinct()
    said = kinds.select("question").distinct().join(F.broadcast(few(terms)), F.contains(F.lower("question"), F.lower("term"))).select("question", "topic_id").distinct()
    every = kinds.select("question").distinct().join(said, "question", "left_anti").crossJoin(F.broadcast(names.select("topic_id")))
    topics = written(kinds.join(said.unionByName(every), "question"), "asked-topics")
    evolved = written(evolved, "evolved")
    keys, ask = ["question", "lo", "hi"], asked.select("question_id", "question", "lo", "hi")
    grown = topics.filter("hybrid_kind <> 'experts'").join(evolved, "topic_id").filter(F.col("year").between(F.col("lo"), F.col("hi")) & (~F.col("emerging_only") | F.col("is_emerging"))).join(names, "topic_id")
    trends = evidence.from_trends(ask.join(_top(grown, keys, [F.desc("growth_score"), F.desc("year"), "topic_id"], most), keys))
    if topics.filter("hybrid_kind <> 'trends'").isEmpty():
        return trends
    if "years" not in scores.columns:
        active = c.author_lines.join(assigned, "publication_id").join(c.dated.select("publication_id", "year"), "publication_id")
        scores = scores.join(active.groupBy("author_id", "topic_id").agg(F.collect_set("year").alias("years")), ["author_id", "topic_id"])
    order = [F.desc("expertise_score"), "author_id", "topic_id"]
    each = scores.select("author_id", "topic_id", "expertise_score", F.explode("years").alias("year"))
    each = written(_top(each, ["topic_id", "year"], order, most), "experts")  # the best of a range are among the best of its years
    wanted = topics.filter("hybrid_kind <> 'trends'").select(*keys, "topic_id").join(each, "topic_id").filter(F.col("year").between(F.col("lo"), F.col("hi"))).drop("year").distinct()
    good = written(_top(wanted, keys, order, most), "experts").join(c.authors.select("author_id", "author_name"), "author_id")
    return trends.unionByName(evidence.from_experts(ask.join(good, keys)))


def embedded_hits(c: Corpus, asked: DataFrame, encoder, size: int, k: int = 8, threshold: float = 0.48) -> DataFrame:
    """Hits (question_id, publication_id, similarity) of asked (question_id, question, lo, hi): chunk texts and distinct
    questions by the same encoder, each searched among its own years' publications."""
    texts = vector.embed_chunks(c.chunks.filter("trim(chunk_text) <> ''"), encoder, "questions", "1", size).filter("valid AND exists(embedding, x -> x <> 0)").select("chunk_id", "embedding")
    rows = texts.join(c.chunks.select("chunk_id", "publication_id"), "chunk_id").join(c.dated.select(F.col("publication_id").cast("long").alias("publication_id"), "year"), "publication_id")
    rows = written(rows, "chunk-texts")
    distinct = asked.select("question", "lo", "hi").distinct().withColumn("query_id", F.xxhash64("question", "lo", "hi"))
    queries = vector.embed_chunks(distinct.withColumnRenamed("query_id", "chunk_id"), encoder, "questions", "1", size, "question").filter("valid AND exists(embedding, x -> x <> 0)").select(F.col("chunk_id").alias("query_id"), "embedding")
    queries = written(queries.join(distinct, "query_id"), "question-vectors")
    conditions = queries.select("query_id", "embedding", F.col("lo").alias("year_low"), F.col("hi").alias("year_high"))
    found = vector.vector_search(rows, conditions, k, threshold).select("query_id", F.col("publication_id"), "similarity")
    return asked.withColumn("query_id", F.xxhash64("question", "lo", "hi")).join(found, "query_id").select("question_id", F.col("publication_id").cast("string").alias("publication_id"), "similarity")


def answer_batch(c: Corpus, asked: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], evolved: DataFrame, terms: DataFrame, assigned: DataFrame, scores: DataFrame, encoder, size: int, most: int = 5) -> DataFrame:
    """One row per question (question_id, question): route, status and answer text.

    A text is answered once, whatever the number of questions that have it, and a name is resolved once. edges: the
    collaboration graph, or f(nodes) that gives its edges at these nodes (a column node). scores may name the years of
    each author and topic (years), else they are looked up in assigned. The relational route
    answers the question's intent within its years and author; the graph route lists partners of the
    author; the hybrid route trends and experts of its topics in its years; the vector route the
    publications whose chunk texts are near to the question by the encoder. Status is
    needs_clarification or not_found where the name stays open or where there is no evidence.
    """
    q = written(asked.select("question").distinct(), "texts")
    q = questions.read(q.select(F.col("question").alias("question_id"), "question"))  # a text stands for itself until the end
    people = q.filter("author_name is not null").select(F.lower("author_name").alias("low")).distinct()
    named = people.select(F.col("low").alias("ask_id"), F.col("low").alias("name"))
    resolved = entities.resolve_authors(named, c.authors, c.author_lines).select(F.col("ask_id").alias("low"), F.col("status").alias("name_status"), "entity_id")
    q = q.join(resolved, F.lower("author_name") == F.col("low"), "left").drop("low")
    q = written(q, "questions")  # read and resolved once; all routes start from it
    open_name = F.col("author_name").isNotNull() & (F.col("name_status") != "resolved")
    ready = q.filter(~F.coalesce(open_name, F.lit(False)))
    low = F.when(F.col("year_op") == "gt", F.col("year_from") + 1).otherwise(F.col("year_from"))
    high = F.when(F.col("year_op") == "lt", F.col("year_to") - 1).otherwise(F.col("year_to"))
    ready = ready.withColumns({"author": F.coalesce("entity_id", F.lit("")), "lo": F.coalesce(low, F.lit(questions.YEAR_LOW)), "hi": F.coalesce(high, F.lit(questions.YEAR_HIGH))})

    relational = _relational(c, ready.filter("route = 'sql'").select("question_id", "intent", "author", "lo", "hi", "requested_limit"))

    wanted = ready.filter("route = 'graph' AND entity_id IS NOT NULL").select("question_id", F.col("entity_id").alias("node"))
    nodes = wanted.select("node").distinct()
    near = written(graph.partners(edges(nodes) if callable(edges) else edges, nodes, most), "near")
    partners, _ = evidence.from_edges(wanted.join(near, "node"), c.publications_of(near.select(F.explode("via").alias("publication_id"))))

    hybrid = _hybrid(c, ready.filter("route = 'hybrid'"), evolved, terms, assigned, scores, most)
    hits = embedded_hits(c, ready.filter("route = 'vector'").select("question_id", "question", "lo", "hi"), encoder, size)
    hits = written(hits, "hits")
    matches = evidence.from_matches(hits.join(c.publications_of(hits).select("publication_id", "title", "year", "doi"), "publication_id"))

    # A route at a time: one plan of all of them would take the driver's memory.
    rows = functools.reduce(DataFrame.unionByName, [written(route, "evidence") for route in (relational, partners, hybrid, matches)])
    texts = evidence.answer_text(evidence.rank_evidence(evidence.merge_evidence(rows)), LIMIT_MOST)
    status = F.when(F.coalesce(open_name, F.lit(False)), F.when(F.col("name_status") == "needs_clarification", "needs_clarification").otherwise("not_found")).when(F.col("answer").isNull(), "not_found").otherwise("ok")
    told = written(q.join(texts, "question_id", "left").select(F.col("question").alias("_text"), "route", status.alias("status"), "answer"), "answers")
    return asked.join(told, F.col("question").eqNullSafe(F.col("_text"))).select("question_id", "route", "status", "answer")
