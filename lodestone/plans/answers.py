"""Registered queries of entity resolution, questions, evidence, data quality, cleaning and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import citation, normalize_text, normalize_title, period_label, token_overlap
from lodestone.operators import conversation, entities, evidence, graph, keys, quality, questions, relational, topics, vector
from lodestone.plans.research import _ASSIGNED, _EDGES, _EVOLUTION, _EXPERTISE, assigned, evolution, expertise, queries_of, search_sql
from lodestone.sources.corpus import Corpus, load, with_corpus
from lodestone.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Entities: asked names come from the tables themselves

_ASKS = """asks AS (SELECT p_partkey AS ask_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name || ' #' || p_partkey) WHEN 1 THEN p_name WHEN 2 THEN p_name || ' #' || p_partkey || 'x' ELSE substr(p_name, 1, 2) END AS name FROM part)"""
_RESOLVE = """norm AS (SELECT ask_id, name, lower(name) AS low, trim(regexp_replace(lower(regexp_replace(name, '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g')) AS norm FROM asks WHERE length(trim(name)) >= 3),
    ent AS (SELECT {id} AS entity_id, {name} AS entity_name, lower({name}) AS low, trim(regexp_replace(lower(regexp_replace({norm}, '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g')) AS norm FROM {table}),
    exact AS (SELECT DISTINCT ask_id, entity_id FROM norm a JOIN ent e ON a.low = e.low OR a.norm = e.norm OR a.low = e.norm OR a.norm = e.low),
    part_ AS (SELECT ask_id, entity_id FROM norm a JOIN ent e ON contains(e.low, a.low) WHERE ask_id NOT IN (SELECT ask_id FROM exact)),
    cnt AS (SELECT {id} AS entity_id, count(DISTINCT publication_id) AS n FROM {links} GROUP BY 1),
    m AS (SELECT ask_id, entity_id, entity_name, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY ask_id ORDER BY coalesce(n, 0) DESC, entity_name, entity_id) AS r FROM (SELECT * FROM exact UNION ALL SELECT * FROM part_) JOIN ent USING (entity_id) LEFT JOIN cnt USING (entity_id)),
    g AS (SELECT ask_id, count(*) AS matches, max(CASE WHEN r = 1 THEN entity_id END) AS best, list(entity_id || '|' || entity_name || '|' || n ORDER BY r) FILTER (r <= 5) AS candidates FROM m GROUP BY 1)
    SELECT ask_id, CASE WHEN length(trim(name)) < 3 THEN 'skipped' WHEN coalesce(matches, 0) = 0 THEN 'not_found' WHEN matches = 1 OR {narrow} THEN 'resolved' ELSE 'needs_clarification' END AS status, coalesce(matches, 0) AS matches,
    CASE WHEN matches = 1 OR ({narrow} AND matches > 0) THEN best END AS entity_id, CASE WHEN matches > 1 THEN candidates END AS candidates, coalesce(matches, 0) > 1 AND {narrow} AS narrowed FROM asks LEFT JOIN g USING (ask_id)"""


def _resolve_sql(**parts: str) -> str:
    out = _RESOLVE
    for k, v in parts.items():
        out = out.replace("{" + k + "}", v)
    return out


@query("n1_resolve_authors", with_corpus("authors pub_author", _ASKS + ", " + _resolve_sql(id="author_id", name="author_name", norm="author_name_normalized", table="authors", links="pub_author", narrow="false")))
def resolve_authors(spark, d):
    """A name asked for every part."""
    c = Corpus(spark, d)
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.upper(F.concat("p_name", F.lit(" #"), key))).when(F.col("p_partkey") % 4 == 1, F.col("p_name")).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" #"), key, F.lit("x"))).otherwise(F.substring("p_name", 1, 2))
    asks = load(spark, d, "part").select(F.col("p_partkey").alias("ask_id"), name.alias("name"))
    return entities.resolve_authors(asks, c.authors, c.author_lines)


@query("n2_resolve_institutions", with_corpus("institutions pub_institution", "asks AS (SELECT s_suppkey AS ask_id, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN substr(s_name, 1, 17) ELSE 'none ' || s_name END AS name FROM supplier), "
       + _resolve_sql(id="institution_id", name="institution_name", norm="institution_name_normalized", table="institutions", links="pub_institution", narrow="true")))
def resolve_institutions(spark, d):
    c = Corpus(spark, d)
    k = F.col("s_suppkey") % 3
    asks = load(spark, d, "supplier").select(F.col("s_suppkey").alias("ask_id"), F.when(k == 0, F.lower("s_name")).when(k == 1, F.substring("s_name", 1, 17)).otherwise(F.concat(F.lit("none "), F.col("s_name"))).alias("name"))
    return entities.resolve_institutions(asks, c.institutions, c.pub_institution)


# Questions: one for every order, by fixed templates

_TEMPLATES = ["How many publications after %d?", "Top 5 most productive authors between %d and 2001", "emerging trends in widgets since %d", "Who collaborates with Red Widget?", "papers on bolts in %d", "total funding before %d", "average citations in %d", "list publications by Blue Gear from 1999 to %d", "experts > %d", "anything at all"]
_QUESTIONS = "qs AS (SELECT o_orderkey AS question_id, replace([" + ", ".join(f"'{t}'" for t in _TEMPLATES) + "][(o_orderkey % 10 + 1)::INT], '%d', year(o_orderdate)::VARCHAR) AS question FROM orders)"


def question_table(spark, d) -> DataFrame:
    """A question for every order."""
    texts = F.array(*(F.lit(t) for t in _TEMPLATES))
    o = load(spark, d, "orders")
    text = F.replace(F.element_at(texts, (F.col("o_orderkey") % 10 + 1).cast("int")), F.lit("%d"), F.year("o_orderdate").cast("string"))
    return o.select(F.col("o_orderkey").alias("question_id"), text.alias("question"))


def _cases(rules) -> str:
    return " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in rules)


@query("n3_route", _QUESTIONS.join(["WITH ", f" SELECT question_id, question, CASE {_cases(questions.ROUTES)} ELSE 'vector' END AS route, CASE WHEN CASE {_cases(questions.ROUTES)} END IS NULL THEN 'fallback' ELSE 'pattern' END AS route_reason FROM qs"]))
def route(spark, d):
    return questions.route(question_table(spark, d))


@query("n4_intent", _QUESTIONS.join(["WITH ", f" SELECT question_id, question, CASE {_cases(questions.INTENTS)} END AS intent FROM qs"]))
def intent(spark, d):
    return questions.intent(question_table(spark, d))


@query("n5_year_filter", _QUESTIONS.join(["WITH ", r""", e AS (SELECT question_id, question, lower(question) AS q FROM qs),
    x AS (SELECT *, try_cast(regexp_extract(q, '(?:between|from)\s+(\d{4})\s*(?:and|to|-)\s*(\d{4})', 1) AS INT) AS a, try_cast(regexp_extract(q, '(?:between|from)\s+(\d{4})\s*(?:and|to|-)\s*(\d{4})', 2) AS INT) AS b,
      try_cast(regexp_extract(q, '\b(?:after|since|from)\s+(\d{4})', 1) AS INT) AS aft, try_cast(regexp_extract(q, '\b(?:before|until|up to)\s+(\d{4})', 1) AS INT) AS bef, try_cast(regexp_extract(q, '>\s*(\d{4})', 1) AS INT) AS ov, try_cast(regexp_extract(q, '\b(\d{4})\b', 1) AS INT) AS bare FROM e)
    SELECT question_id, question, CASE WHEN a IS NOT NULL THEN 'between' WHEN aft IS NOT NULL THEN 'gte' WHEN bef IS NOT NULL THEN 'lte' WHEN ov IS NOT NULL THEN 'gt' WHEN bare IS NOT NULL THEN 'eq' END AS year_op,
    CASE WHEN a IS NOT NULL THEN least(a, b) WHEN aft IS NOT NULL THEN aft WHEN bef IS NOT NULL THEN NULL WHEN ov IS NOT NULL THEN ov ELSE bare END AS year_from,
    CASE WHEN a IS NOT NULL THEN greatest(a, b) WHEN aft IS NOT NULL THEN NULL WHEN bef IS NOT NULL THEN bef WHEN ov IS NOT NULL THEN NULL ELSE bare END AS year_to FROM x"""]))
def year_filter(spark, d):
    return questions.years(question_table(spark, d))


@query("n9_fold_years", "WITH y AS (" + ORACLE_SQL["n5_year_filter"] + """), f AS (SELECT *, CASE WHEN question_id % 7 = 0 THEN 2000 END AS filter_year, CASE WHEN question_id % 11 = 0 THEN 1996 END AS filter_from, question_id % 7 = 0 OR question_id % 11 = 0 AS given FROM y)
    SELECT question_id, question, CASE WHEN NOT given AND year_op = 'eq' THEN year_from ELSE filter_year END AS filter_year, CASE WHEN NOT given AND year_op IN ('gte', 'between') THEN year_from ELSE filter_from END AS filter_from,
    CASE WHEN NOT given AND year_op IN ('lte', 'between') THEN year_to END AS filter_to, CASE WHEN NOT given AND year_op IN ('gt', 'lt') THEN year_op END AS dropped_op FROM f""")
def folded_years(spark, d):
    """Years of questions as filters; every seventh question has a year given, every eleventh a first year."""
    k = F.col("question_id")
    given = {"filter_year": F.when(k % 7 == 0, 2000), "filter_from": F.when(k % 11 == 0, 1996), "filter_to": F.lit(None).cast("int")}
    asked = questions.years(question_table(spark, d)).withColumns(given)
    return questions.fold_years(asked).select("question_id", "question", "filter_year", "filter_from", "filter_to", "dropped_op")


# The same templates as read by hand: key, route, reason, intent, operator, author, limit, kind, emerging, topic words.
_READINGS = """(0, 'sql', 'pattern', 'count', 'gte', NULL, 10, 'combined', false, NULL), (1, 'sql', 'pattern', 'top_authors', 'between', NULL, 5, 'experts', false, NULL), (2, 'hybrid', 'pattern', NULL, 'gte', NULL, 10, 'trends', true, NULL),
    (3, 'graph', 'pattern', NULL, NULL, 'Red Widget', 10, 'experts', false, NULL), (4, 'vector', 'pattern', NULL, 'eq', NULL, 10, 'combined', false, 'bolts'), (5, 'sql', 'pattern', 'funding', 'lte', NULL, 10, 'combined', false, NULL),
    (6, 'sql', 'pattern', 'average_citations', 'eq', NULL, 10, 'combined', false, NULL), (7, 'sql', 'pattern', 'list', 'between', 'Blue Gear', 10, 'combined', false, NULL), (8, 'hybrid', 'pattern', NULL, 'gt', NULL, 10, 'experts', false, NULL),
    (9, 'vector', 'fallback', NULL, NULL, NULL, 10, 'combined', false, NULL)"""


@query("n6_read_questions", _QUESTIONS.join(["WITH ", f""", g(k, route, route_reason, intent, year_op, author_name, requested_limit, hybrid_kind, emerging_only, topic_words) AS (VALUES {_READINGS}),
    y AS (SELECT o_orderkey AS question_id, year(o_orderdate)::INT AS y FROM orders)
    SELECT question_id, question, route, route_reason, intent, year_op, CASE WHEN year_op = 'between' THEN least(y, CASE k WHEN 1 THEN 2001 ELSE 1999 END) WHEN year_op IN ('gte', 'gt', 'eq') THEN y END AS year_from,
      CASE WHEN year_op = 'between' THEN greatest(y, CASE k WHEN 1 THEN 2001 ELSE 1999 END) WHEN year_op IN ('lte', 'eq') THEN y END AS year_to, author_name, NULL::VARCHAR AS institution_name, requested_limit::INT AS requested_limit,
      hybrid_kind, emerging_only, 'partners' AS graph_template, topic_words FROM qs JOIN y USING (question_id) JOIN g ON k = question_id % 10"""]))
def read_questions(spark, d):
    """All columns of a read question."""
    return questions.read(question_table(spark, d))


@query("p9_ignored_filters", _QUESTIONS.join(["WITH ", f", r AS (SELECT question_id, CASE {_cases(questions.ROUTES)} ELSE 'vector' END AS route, CASE WHEN question_id % 2 = 0 THEN 1999 END AS year, CASE WHEN question_id % 3 = 0 THEN 'ASIA' END AS country FROM qs)" + """
    SELECT question_id, list_filter([CASE WHEN year IS NOT NULL AND route NOT IN ('sql', 'vector', 'hybrid') THEN 'year' END, CASE WHEN country IS NOT NULL AND route NOT IN ('sql', 'vector') THEN 'country' END], lambda x: x IS NOT NULL) AS filters_ignored FROM r"""]))
def ignored_filters(spark, d):
    q = question_table(spark, d).withColumns({"year": F.when(F.col("question_id") % 2 == 0, F.lit(1999)), "country": F.when(F.col("question_id") % 3 == 0, F.lit("ASIA"))})
    return questions.ignored(questions.route(q), ["year", "country"]).select("question_id", "filters_ignored")


# Evidence

_HITS = search_sql(0.48, 8) + ", pubs_ AS (SELECT publication_id, title, year, doi FROM publications)"


def _matches(spark, d) -> DataFrame:
    c = Corpus(spark, d)
    hits = vector.vector_search(c.chunks, queries_of(c)).withColumn("publication_id", F.col("publication_id").cast("string"))
    return hits.join(c.publications.select("publication_id", "title", "year", "doi"), "publication_id").withColumnRenamed("query_id", "question_id")


def _cite(t: str = "title", y: str = "year", i: str = "doi") -> str:
    return f"'[' || coalesce(nullif(trim({t}), ''), 'Untitled') || ', ' || coalesce({y}::VARCHAR, 'n.d.') || ', ' || coalesce(nullif(trim({i}), ''), 'no-doi') || ']'"


@query("r2_match_evidence", with_corpus("chunks publications", _HITS + f""" SELECT query_id AS question_id, {_cite()} AS claim, similarity AS value_num, coalesce(year::VARCHAR, 'all-time') AS period, p.publication_id AS primary_source, least(greatest(similarity, 0), 1) AS confidence,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, {_cite()})::INT AS rank FROM hits h JOIN pubs_ p ON p.publication_id = h.publication_id::VARCHAR"""))
def match_evidence(spark, d):
    rows = evidence.rank_evidence(evidence.merge_evidence(evidence.from_matches(_matches(spark, d))))
    return rows.select("question_id", "claim", "value_num", "period", F.element_at("sources", 1)["publication_id"].alias("primary_source"), "confidence", "rank")


@query("r3_edge_evidence", with_corpus("pub_author", _EDGES + """, strong AS (SELECT * FROM edges WHERE weight >= 3)
    SELECT node_a AS question_id, node_a || ' and ' || node_b || ' share ' || weight || ' publications' AS claim, weight::DOUBLE AS value_num, len(via) AS n_sources, row_number() OVER (PARTITION BY node_a ORDER BY weight DESC, node_a || ' and ' || node_b || ' share ' || weight || ' publications')::INT AS rank FROM strong"""))
def edge_evidence(spark, d):
    c = Corpus(spark, d)
    edges = graph.collaboration_edges(c.author_lines, "publication_id", "author_id", 3).select(F.col("node_a").alias("question_id"), F.col("node_a").alias("node"), F.col("node_b").alias("partner"), "weight", "via")
    rows, _ = evidence.from_edges(edges, c.publications)
    return evidence.rank_evidence(rows).select("question_id", "claim", "value_num", F.size("sources").alias("n_sources"), "rank")


@query("r1_row_evidence", with_corpus("publications institutions pub_institution", f"""c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
    i AS (SELECT institution_id, count(*) AS n FROM pub_institution GROUP BY 1)
    SELECT c_custkey::VARCHAR AS question_id, CASE WHEN n > 0 THEN 'There are ' || n || ' publications' END AS claim, CASE WHEN n > 0 THEN 'count' END AS metric, CASE WHEN n > 0 THEN n::DOUBLE END AS value_num, CASE WHEN n > 0 THEN 'all-time' END AS period, CASE WHEN n = 0 THEN 'zero_aggregate' END AS zero_evidence_class FROM c
    UNION ALL SELECT city, institution_name || ' has ' || n || ' publications', 'publication_count_ranking', n, 'all-time', NULL FROM institutions JOIN i USING (institution_id)
    UNION ALL SELECT document_type, {_cite()}, 'citation_count', citation_count, coalesce(year::VARCHAR, 'all-time'), NULL FROM publications"""))
def row_evidence(spark, d):
    """Evidence from a count for every customer (none for 0), from institutions ranked by publications, from listed publications."""
    c = Corpus(spark, d)
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = load(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").cast("string").alias("question_id"), F.coalesce("n", F.lit(0)).alias("n"))
    counted = evidence.zero_class(counts, "n").join(evidence.from_count(counts, "n"), "question_id", "left")
    sizes = c.pub_institution.groupBy("institution_id").agg(F.count(F.lit(1)).alias("publication_count"))
    ranked = evidence.from_ranking(c.institutions.join(sizes, "institution_id").withColumn("question_id", F.col("city")), "institution_name", "publication_count", "publications")
    listed = evidence.from_publications(c.publications.withColumn("question_id", F.col("document_type")))
    return counted.unionByName(ranked.unionByName(listed), allowMissingColumns=True).select("question_id", "claim", "metric", "value_num", "period", "zero_evidence_class")


@query("r4_topic_evidence", with_corpus("publications keywords pub_author authors", _EXPERTISE + _EVOLUTION.removeprefix(_ASSIGNED) + """
    SELECT topic_id AS question_id, topic_name || ' grew by ' || growth_score || ' in ' || year AS claim, 'growth_score' AS metric, growth_score AS value_num, year::VARCHAR AS period FROM evolved JOIN topic_names USING (topic_id) WHERE growth_score IS NOT NULL
    UNION ALL SELECT topic_id, author_name || ' scores ' || expertise_score, 'expertise_score', expertise_score, 'all-time' FROM scores JOIN authors USING (author_id)"""))
def topic_evidence(spark, d):
    """Evidence from the growth of every topic and year, and from every author's expertise in a topic."""
    named = evolution(spark, d).filter("growth_score is not null").join(assigned(spark, d)[2], "topic_id")
    scored = expertise(spark, d).join(Corpus(spark, d).authors.select("author_id", "author_name"), "author_id")
    rows = evidence.from_trends(named.withColumn("question_id", F.col("topic_id"))).unionByName(evidence.from_experts(scored.withColumn("question_id", F.col("topic_id"))))
    return rows.select("question_id", "claim", "metric", "value_num", "period")


_SOURCES = """src AS (SELECT o_custkey AS question_id, (o_orderkey % 50)::VARCHAR AS publication_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 4 > 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 5 > 0 THEN '10.1000/' || (o_orderkey % 50) END AS doi,
    (o_orderkey % 7) / 7 AS relevance, o_orderkey AS position, o_orderstatus AS provenance FROM orders)"""


def source_rows(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), (k % 50).cast("string").alias("publication_id"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("title"), F.when(k % 4 > 0, F.year("o_orderdate")).alias("year"), F.when(k % 5 > 0, F.concat(F.lit("10.1000/"), (k % 50).cast("string"))).alias("doi"), ((k % 7) / 7).alias("relevance"), k.alias("position"), F.col("o_orderstatus").alias("provenance"))


@query("a18_source_types", "WITH " + _SOURCES + " SELECT question_id, provenance AS source_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY question_id), 6) AS share FROM src GROUP BY 1, 2")
def source_types(spark, d):
    return relational.source_types(source_rows(spark, d).withColumnRenamed("provenance", "source_type"), "question_id")


@query("a18_relevance_year", "WITH " + _SOURCES + " SELECT question_id, year, count(*) AS count, round(avg(relevance), 6) AS mean_relevance FROM src WHERE year IS NOT NULL GROUP BY 1, 2")
def relevance_year(spark, d):
    return relational.relevance_by_year(source_rows(spark, d), "question_id")


@query("r7_merge_sources", "WITH " + _SOURCES + """ SELECT question_id, publication_id, max(relevance) AS relevance, arg_min(title, position) FILTER (title IS NOT NULL) AS title, arg_min(year, position) FILTER (year IS NOT NULL) AS year, arg_min(doi, position) FILTER (doi IS NOT NULL) AS doi,
    (SELECT string_agg(v, '; ' ORDER BY f) FROM (SELECT provenance AS v, min(position) AS f FROM src s2 WHERE s2.question_id = src.question_id AND s2.publication_id = src.publication_id GROUP BY 1)) AS provenance FROM src GROUP BY question_id, publication_id""")
def merge_sources(spark, d):
    return evidence.merge_sources(source_rows(spark, d))


@query("t9_rank_sources", "WITH " + _SOURCES + " SELECT question_id, position, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(relevance, 0) DESC, coalesce(year, 0) DESC, coalesce(title, ''), publication_id, position)::INT AS rank FROM src")
def rank_sources(spark, d):
    from pyspark.sql import Window

    merged = source_rows(spark, d)
    w = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), F.desc(F.coalesce("year", F.lit(0))), F.coalesce("title", F.lit("")), "publication_id", "position")
    return merged.withColumn("rank", F.row_number().over(w)).select("question_id", "position", "rank")


@query("r8_merge_evidence", "WITH " + _SOURCES + """, e AS (SELECT question_id, provenance AS claim, coalesce(title, 'none') AS metric, relevance, publication_id FROM src)
    SELECT question_id, claim, metric, max(relevance) AS confidence, list_sort(list(DISTINCT publication_id)) AS ids FROM e GROUP BY question_id, claim, metric""")
def merge_evidence(spark, d):
    s = source_rows(spark, d)
    src = F.array(F.struct("publication_id", "title", "year", "doi", "relevance"))
    e = s.select("question_id", F.col("provenance").alias("claim"), F.coalesce("title", F.lit("none")).alias("metric"), F.lit(None).cast("string").alias("value_str"), F.lit("all-time").alias("period"), F.lit(None).cast("double").alias("value_num"), F.col("relevance").alias("confidence"), src.alias("sources"))
    return evidence.merge_evidence(e).select("question_id", "claim", "metric", "confidence", F.transform("sources", lambda x: x["publication_id"]).alias("ids"))


_ROUTES = """u AS (SELECT o_custkey AS question_id, o_orderkey AS position, CASE o_orderkey % 3 WHEN 0 THEN 'Topic ' || (o_orderkey % 4) || ' grew by ' || (o_orderkey % 5) || ' (all-time)' WHEN 1 THEN 'Author ' || (o_orderkey % 4) || ' scores ' || (o_orderkey % 5) || ' in a related topic (' || year(o_orderdate) || ')' ELSE o_orderstatus END AS claim,
      CASE o_orderkey % 3 WHEN 0 THEN 'growth_score' WHEN 1 THEN 'expertise_score' ELSE 'count' END AS metric, (o_orderkey % 5)::DOUBLE AS value_num, CASE WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 7) / 7 ELSE 1 END AS confidence,
      CASE WHEN o_orderkey % 3 = 1 THEN year(o_orderdate)::VARCHAR ELSE 'all-time' END AS period, CASE WHEN o_orderkey % 4 > 0 THEN 'filter-' || (o_orderkey % 4) END AS ignored, CASE WHEN o_orderkey % 5 > 1 THEN 'step ' || (o_orderkey % 5) END AS lineage FROM orders)"""


@query("u2_unify", "WITH " + _SOURCES + ", " + _ROUTES + """, c AS (SELECT question_id, claim, metric, value_num, period, max(confidence) AS confidence FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, value_num DESC NULLS LAST, metric, claim) AS rank FROM c),
    s AS (SELECT question_id, count(DISTINCT publication_id) AS n_sources FROM src GROUP BY 1),
    i AS (SELECT question_id, list(v ORDER BY f) AS filters_ignored FROM (SELECT question_id, ignored AS v, min(position) AS f FROM u WHERE ignored IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT question_id, string_agg(v, '; ' ORDER BY f) AS lineage FROM (SELECT question_id, lineage AS v, min(position) AS f FROM u WHERE lineage IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT question_id, list(claim ORDER BY rank) AS claims, any_value(n_sources) AS n_sources, coalesce(any_value(filters_ignored), []) AS filters_ignored, any_value(lineage) AS lineage FROM r JOIN s USING (question_id) LEFT JOIN i USING (question_id) LEFT JOIN l USING (question_id) GROUP BY 1""")
def unified(spark, d):
    """Three routes' evidence for each customer's question: generic growth and expertise rows, and counts; their sources, ignored filters and lineage."""
    o = load(spark, d, "orders")
    k, question = F.col("o_orderkey"), F.col("o_custkey").alias("question_id")
    score, n = (k % 5).cast("int"), (k % 4).cast("string")
    rows = o.filter(k % 3 < 2).select(
        question, F.when(k % 3 == 1, F.year("o_orderdate").cast("string")).alias("period"), F.when(k % 3 == 1, F.concat(F.lit("Author "), n)).alias("author_name"),
        F.when(k % 3 == 1, score).alias("expertise_score"), F.when(k % 3 == 0, F.concat(F.lit("Topic "), n)).alias("topic_name"), F.when(k % 3 == 0, score).alias("growth_score"))
    counts = evidence.evidence(o.filter(k % 3 == 2), F.col("o_custkey"), F.col("o_orderstatus"), "count", score, conf=(k % 7) / 7)
    notes = o.select(question, k.alias("position"), F.when(k % 4 > 0, F.concat(F.lit("filter-"), n)).alias("ignored"), F.when(k % 5 > 1, F.concat(F.lit("step "), score.cast("string"))).alias("lineage"))
    claims, sources, told = evidence.unify(evidence.from_analytics(rows).unionByName(counts), source_rows(spark, d), notes)
    listed = claims.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim"))), lambda s: s["claim"]).alias("claims"))
    return listed.join(sources.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_sources")), "question_id").join(told, "question_id")


@query("r14_context_block", "WITH " + _SOURCES + f""", m AS (SELECT question_id, publication_id, max(relevance) AS relevance, arg_min(title, position) FILTER (title IS NOT NULL) AS title, arg_min(year, position) FILTER (year IS NOT NULL) AS year, arg_min(doi, position) FILTER (doi IS NOT NULL) AS doi,
      (SELECT string_agg(v, '; ' ORDER BY f) FROM (SELECT provenance AS v, min(position) AS f FROM src s2 WHERE s2.question_id = src.question_id AND s2.publication_id = src.publication_id GROUP BY 1)) AS provenance FROM src GROUP BY question_id, publication_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(relevance, 0) DESC, coalesce(year, 0) DESC, coalesce(title, ''), publication_id) AS rank FROM m)
    SELECT question_id, string_agg('[' || rank || '] ' || {_cite()} || ' | score ' || format('{{:.4f}}', relevance) || ' | from ' || provenance, chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 20 GROUP BY 1""")
def context_block(spark, d):
    return evidence.context_block(evidence.rank_sources(evidence.merge_sources(source_rows(spark, d))))


@query("r9_items", """WITH i AS (SELECT o_custkey AS question_id, o_orderkey AS position, CASE o_orderkey % 2 WHEN 0 THEN 'paper' ELSE 'topic' END AS source_type, (o_orderkey % 2) || '-' || (o_orderkey % 5) AS source_id, repeat(o_orderstatus, (o_orderkey % 7)::INT) AS content,
      (o_orderkey % 5) / 5 AS score, (o_orderkey % 3) / 3 AS confidence, o_orderstatus AS provenance, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate)::INT END AS year, o_orderpriority AS note FROM orders),
    m AS (SELECT question_id, source_type, source_id, arg_max(content, {'a': length(content), 'b': -position}) AS content, max(score) AS score, max(confidence) AS confidence, list_sort(list(DISTINCT provenance)) AS provenance_ids,
      arg_min(year, position) FILTER (year IS NOT NULL) AS year, arg_min(note, position) AS note FROM i GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, confidence DESC, year DESC NULLS LAST, content, source_id)::INT AS rank FROM m""")
def items(spark, d):
    """Items of all kinds as one ranked list for each customer's question: longest content, greatest scores, the earliest metadata."""
    k = F.col("o_orderkey")
    year = F.when(k % 3 > 0, F.create_map(F.lit("year"), F.year("o_orderdate").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    each = load(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), k.alias("position"), F.when(k % 2 == 0, "paper").otherwise("topic").alias("source_type"), F.concat_ws("-", (k % 2).cast("string"), (k % 5).cast("string")).alias("source_id"),
        F.repeat("o_orderstatus", (k % 7).cast("int")).alias("content"), ((k % 5) / 5).alias("score"), ((k % 3) / 3).alias("confidence"), F.array("o_orderstatus").alias("provenance_ids"),
        F.map_concat(year, F.create_map(F.lit("note"), F.col("o_orderpriority"))).alias("metadata"),
    )
    merged = evidence.merge_items(each).withColumns({"year": F.try_element_at("metadata", F.lit("year")).cast("int"), "note": F.try_element_at("metadata", F.lit("note")), "title": F.col("content")})
    return evidence.rank_items(merged).select("question_id", "source_type", "source_id", "content", "score", "confidence", "provenance_ids", "year", "note", "rank")


@query("r12_verify_citations", with_corpus("publications", f"""base AS (SELECT publication_id, title, year, doi FROM publications WHERE title IS NOT NULL), cites AS (SELECT publication_id AS answer_id, title, doi,
      CASE publication_id::INT % 3 WHEN 1 THEN year + 1 ELSE year END AS year, CASE WHEN publication_id::INT % 7 = 0 THEN title || ' extra words that differ' ELSE title END AS cited FROM base)
    SELECT answer_id, CASE WHEN answer_id::INT % 3 = 1 OR answer_id::INT % 7 = 0 THEN 'Claim' ELSE 'Claim ' || {_cite('cited')} END AS text FROM cites"""))
def verify(spark, d):
    base = Corpus(spark, d).publications.filter("title is not null")
    k = F.col("publication_id").cast("int")
    cited = F.when(k % 7 == 0, F.concat("title", F.lit(" extra words that differ"))).otherwise(F.col("title"))
    year = F.when(k % 3 == 1, F.col("year") + 1).otherwise(F.col("year"))
    answers = base.select(F.col("publication_id").alias("answer_id"), F.concat(F.lit("Claim "), citation(cited, year, F.col("doi"))).alias("text"))
    return evidence.verify_citations(answers, base.select(F.col("publication_id").alias("answer_id"), "title", "year", "doi"))[1]


@query("r13_answer_text", with_corpus("chunks publications", _HITS + f""", e AS (SELECT query_id AS question_id, similarity, {_cite()} AS claim, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, {_cite()}) AS rank FROM hits h JOIN pubs_ p ON p.publication_id = h.publication_id::VARCHAR)
    SELECT question_id, string_agg(rank || '. ' || claim || ' ' || claim, chr(10) || chr(10) ORDER BY rank) AS answer FROM e WHERE rank <= 10 GROUP BY 1"""))
def answer_text(spark, d):
    return evidence.answer_text(evidence.rank_evidence(evidence.merge_evidence(evidence.from_matches(_matches(spark, d)))))


@query("f1_normalize", r"""SELECT doc_id, sha256(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS normalized FROM documents""")
def normalized(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(normalize_text(F.coalesce("text", F.lit(""))), 256).alias("normalized"))


@query("f4_period", "SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 5 = 0 THEN year(o_orderdate)::VARCHAR WHEN o_orderkey % 5 = 1 THEN '1990-' || year(o_orderdate) WHEN o_orderkey % 5 = 2 THEN year(o_orderdate) || '-present' WHEN o_orderkey % 5 = 3 THEN 'up-to-' || year(o_orderdate) ELSE 'all-time' END AS period FROM orders")
def period(spark, d):
    k, y = F.col("o_orderkey") % 5, F.year("o_orderdate")
    low = F.when(k == 1, F.lit(1990)).when(k == 2, y)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), period_label(F.when(k == 0, y), low, F.when(k.isin(1, 3), y)).alias("period"))


@query("f15_overlap", r"""WITH t AS (SELECT p_partkey, lower(p_name) AS a, lower(lead(p_name) OVER (ORDER BY p_partkey)) AS b FROM part), w AS (SELECT p_partkey, a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM t WHERE b IS NOT NULL)
    SELECT p_partkey, CASE WHEN len(x) < 2 OR len(y) < 2 THEN CASE WHEN a = b THEN 1 ELSE 0 END ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS overlap FROM w""")
def overlap(spark, d):
    a = load(spark, d, "part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))  # keys are dense, so the next one is the next row
    return a.join(b, "p_partkey").select("p_partkey", token_overlap(normalize_title(F.col("p_name")), normalize_title(F.col("next"))).alias("overlap"))


# Data quality and cleaning

@query("p4_members", with_corpus("institutions pub_author pub_institution", """asks AS (SELECT s_suppkey AS ask_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR END AS author_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR END AS institution_id,
      CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 9 = 0 THEN 'asia' WHEN s_suppkey % 100 = 1 THEN 'europe' END AS country FROM supplier),
    places AS (SELECT DISTINCT publication_id, lower(country) AS country FROM pub_institution JOIN institutions USING (institution_id))
    SELECT ask_id, p.publication_id FROM asks a JOIN pub_author p ON p.author_id = a.author_id WHERE (a.institution_id IS NULL OR EXISTS (SELECT 1 FROM pub_institution x WHERE x.publication_id = p.publication_id AND x.institution_id = a.institution_id)) AND (a.country IS NULL OR EXISTS (SELECT 1 FROM places x WHERE x.publication_id = p.publication_id AND x.country = a.country))
    UNION ALL SELECT ask_id, p.publication_id FROM asks a JOIN pub_institution p ON p.institution_id = a.institution_id WHERE a.author_id IS NULL AND (a.country IS NULL OR EXISTS (SELECT 1 FROM places x WHERE x.publication_id = p.publication_id AND x.country = a.country))
    UNION ALL SELECT ask_id, p.publication_id FROM asks a JOIN places p ON p.country = a.country WHERE a.author_id IS NULL AND a.institution_id IS NULL"""))
def members(spark, d):
    """An ask for every supplier, of an author, an institution, a country, or several of them."""
    k = F.col("s_suppkey")
    country = F.when((k % 4 == 0) | (k % 9 == 0), "Asia").when(k % 100 == 1, "EUROPE")
    asks = load(spark, d, "supplier").select(k.alias("ask_id"), F.when(k % 2 == 0, k.cast("string")).alias("author_id"), F.when(k % 3 == 0, k.cast("string")).alias("institution_id"), country.alias("country"))
    return relational.members(Corpus(spark, d), asks)


@query("q2_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return quality.key_violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q3_orphans", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("q4_ranges", "SELECT 'price' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE NOT o_totalprice BETWEEN 10000 AND 400000 UNION ALL SELECT 'year', o_orderkey::VARCHAR FROM orders WHERE NOT year(o_orderdate) < 2001")
def ranges(spark, d):
    return quality.range_violations(load(spark, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice").between(10000, 400000), "year": F.year("o_orderdate") < 2001})


@query("q5_edges", with_corpus("pub_author", _EDGES + " SELECT 'unknown_end' AS rule, node_a || '-' || node_b AS key FROM (SELECT node_a, node_b, unnest([node_a, node_b]) AS node FROM edges) WHERE node::INT % 50 = 0"))
def edge_checks(spark, d):
    c = Corpus(spark, d)
    edges = graph.collaboration_edges(c.author_lines, "publication_id", "author_id")
    return quality.edge_violations(edges, c.authors.filter(F.col("author_id").cast("int") % 50 != 0).select(F.col("author_id").alias("node")))


@query("q6_embeddings", with_corpus("chunks", "SELECT count(*) AS chunks, count(*) FILTER (embedding IS NULL) AS without, count(*) FILTER (len(embedding) <> 64) AS other_size, round(count(*) / count(DISTINCT publication_id), 4) AS per_publication FROM chunks"))
def embeddings(spark, d):
    return quality.embedding_report(Corpus(spark, d).chunks, 64)


_STAMPS = "s AS (SELECT chunk_id, 'model-' || label % 2 AS embedding_model, (label % 3)::VARCHAR AS embedding_version, len(embedding)::INT AS embedding_dimension FROM chunks)"


def stamped(spark, d) -> DataFrame:
    """Chunks as if embedded by two models of three versions."""
    label = F.col("label")
    return Corpus(spark, d).chunks.select("chunk_id", F.concat(F.lit("model-"), (label % 2).cast("string")).alias("embedding_model"), (label % 3).cast("string").alias("embedding_version"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dimension"))


@query("q6_versions", with_corpus("chunks", _STAMPS + " SELECT embedding_model, embedding_version, embedding_dimension, count(*) AS chunks, count(*) OVER () <= 1 AS single FROM s GROUP BY 1, 2, 3"))
def versions(spark, d):
    return quality.embedding_versions(stamped(spark, d))


@query("v2_mixed_versions", with_corpus("chunks", _STAMPS + " SELECT DISTINCT embedding_model, embedding_version FROM s WHERE embedding_model <> 'model-0' OR embedding_version <> '1'"))
def mixed(spark, d):
    return vector.mixed_versions(stamped(spark, d), "model-0", "1")


@query("s7_pending", with_corpus("chunks", _STAMPS + " SELECT chunk_id, publication_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM s WHERE embedding_model = 'model-0')"))
def pending_chunks(spark, d):
    """Chunks that a run of model-0 still has to do."""
    done = stamped(spark, d).filter("embedding_model = 'model-0'")
    return vector.pending(Corpus(spark, d).chunks.select("chunk_id", "publication_id"), done)


@query("q8_row_counts", "SELECT 'orders' AS \"table\", count(*) AS rows, 100::BIGINT AS expected, count(*) >= 100 AS ok FROM orders UNION ALL SELECT 'part', count(*), 1000000::BIGINT, count(*) >= 1000000 FROM part")
def counts(spark, d):
    return quality.row_counts({"orders": load(spark, d, "orders"), "part": load(spark, d, "part")}, {"orders": 100, "part": 1_000_000})


@query("s4_backfill", with_corpus("publications", "SELECT publication_id, CASE WHEN publication_id::INT % 2 = 0 THEN CASE WHEN publication_id::INT % 4 = 0 THEN 'link-' || publication_id END ELSE title END AS title FROM publications"))
def backfill(spark, d):
    p = Corpus(spark, d).publications.select("publication_id", "title")
    k = F.col("publication_id").cast("int")
    staged = p.filter(k % 2 == 0).select("publication_id", F.when(k % 4 == 0, F.concat(F.lit("link-"), F.col("publication_id"))).alias("title"))
    return quality.backfill_column(p, staged, "publication_id", "title")[0]


@query("q9_backfill_report", """WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 0.5 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority WHEN o_orderkey % 9 = 0 THEN ' ' END AS v FROM orders WHERE o_orderkey % 2 = 0)
    SELECT count(*) FILTER (k = floor(k)) AS updated, count(*) FILTER (k <> floor(k)) AS orphans, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (trim(v) <> '') AS non_blank, false AS accepted FROM s""")
def backfill_report(spark, d):
    """What a staged column would do to its table, and whether it may: staged keys without a row, nulls and blanks are counted."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    target = o.select(k.cast("string").alias("key"), F.col("o_orderpriority").alias("v"))
    staged = o.filter(k % 2 == 0).select(F.when(k % 50 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")).alias("key"), F.when(k % 3 > 0, F.col("o_orderpriority")).when(k % 9 == 0, " ").alias("v"))
    return quality.backfill_accepted(quality.backfill_column(target, staged, "key", "v")[1])


@query("s5_surrogate_key", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id, o_orderkey FROM orders")
def surrogate(spark, d):
    return keys.add_surrogate_key(load(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("row_id", "o_orderkey")


def records(spark, d) -> DataFrame:
    """Records with copies: of keys that end in 3 by doi in other letters, of every tenth by eid or by title and year.

    A record's title is the publication's with its number, as titles of the adapter repeat.
    """
    p = Corpus(spark, d).publications
    k = F.col("publication_id").cast("int")
    p = p.withColumn("title", F.concat("title", F.lit(" No. "), "publication_id"))
    none = F.lit(None).cast("string")
    copy = p.filter((k % 10 == 0) | (k % 10 == 3)).select(
        F.concat(F.lit("c"), "publication_id").alias("publication_id"),
        F.when(k % 20 == 0, F.col("eid")).alias("eid"),
        F.when(k % 10 == 3, F.upper("doi")).alias("doi"),
        F.when(k % 20 == 10, F.upper("title")).otherwise(none).alias("title"),
        "year",
        (F.col("citation_count") + 1).alias("citation_count"),
    )
    return p.select("publication_id", "eid", "doi", "title", "year", "citation_count").unionByName(copy)


_RECORDS = r"""named AS (SELECT * REPLACE (title || ' No. ' || publication_id AS title) FROM publications),
    rec AS (SELECT publication_id, eid, doi, title, year, citation_count FROM named
      UNION ALL SELECT 'c' || publication_id, CASE WHEN publication_id::INT % 20 = 0 THEN eid END, CASE WHEN publication_id::INT % 10 = 3 THEN upper(doi) END,
        CASE WHEN publication_id::INT % 20 = 10 THEN upper(title) END, year, citation_count + 1 FROM named WHERE publication_id::INT % 10 IN (0, 3)),
    t AS (SELECT publication_id AS k, 'd' || lower(doi) AS v FROM rec WHERE doi IS NOT NULL UNION ALL SELECT publication_id, 'e' || eid FROM rec WHERE eid IS NOT NULL
      UNION ALL SELECT publication_id, 't' || regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g') || '|' || year FROM rec WHERE title IS NOT NULL AND year IS NOT NULL),
    links AS (SELECT DISTINCT a.k AS u, b.k AS v FROM t a JOIN t b ON a.v = b.v), reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u), g AS (SELECT u AS k, min(v) AS group_key FROM reach GROUP BY 1)"""


def _tiers() -> dict:
    """Doi, eid, then normalised title and year."""
    title = F.nullif(F.trim(F.regexp_replace(normalize_title(F.col("title")), r"\s+", " ")), F.lit(""))
    return {"doi": F.lower("doi"), "eid": F.col("eid"), "title": F.when(title.isNotNull() & F.col("year").isNotNull(), F.sha2(F.concat_ws("|", title, F.col("year").cast("string")), 256))}


@query("d3_dedup", with_corpus("publications", _RECORDS + " SELECT publication_id AS key, coalesce(group_key, publication_id) AS group_key FROM rec LEFT JOIN g ON k = publication_id"))
def dedup(spark, d):
    return quality.duplicate_groups(records(spark, d), "publication_id", _tiers()).select("key", "group_key")


@query("d4_merge", with_corpus("publications", _RECORDS + " SELECT coalesce(group_key, publication_id) AS group_key, count(*) AS records, max(year) AS year, max(citation_count) AS citation_count FROM rec LEFT JOIN g ON k = publication_id GROUP BY 1"))
def merge(spark, d):
    r = records(spark, d)
    groups = quality.duplicate_groups(r, "publication_id", _tiers())
    return quality.merge_duplicates(r, groups, "publication_id", ["title", "doi", "eid", "year"], ["citation_count"]).select("group_key", "records", "year", "citation_count")


@query("d1_clean", "SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) AS p_type, lower(trim(p_name)) AS p_name, lower(replace(p_brand, '#', '')) AS p_brand FROM part")
def clean(spark, d):
    return quality.clean(load(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_brand"), {"p_partkey": "id", "p_type": "title", "p_name": "narrative", "p_brand": "normalized"})


@query("d2_quarantine", with_corpus("publications", "SELECT publication_id, 'no doi' AS reason FROM publications WHERE doi IS NULL AND title IS NOT NULL UNION ALL SELECT publication_id, CASE WHEN doi IS NULL THEN 'no doi, no title' ELSE 'no title' END FROM publications WHERE title IS NULL"))
def quarantined(spark, d):
    return quality.quarantine(Corpus(spark, d).publications, ["doi", "title"])[1].select("publication_id", "reason")


# Conversations


@query("c7_block", with_corpus("messages", r"""last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS r FROM messages), t AS (SELECT session_id, seq, upper(role[1]) || lower(role[2:]) AS label, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c FROM last WHERE r <= 6)
    SELECT session_id, string_agg(label || ': ' || CASE WHEN length(c) > 200 THEN rtrim(substr(c, 1, 199)) || '…' ELSE c END, chr(10) ORDER BY seq) AS block FROM t GROUP BY 1"""))
def block(spark, d):
    return conversation.block(Corpus(spark, d).messages)


@query("c1_sessions", with_corpus("messages sessions", r"""f AS (SELECT session_id, count(DISTINCT seq) AS message_count, count(DISTINCT route) AS route_count, arg_max(route, seq) FILTER (route IS NOT NULL) AS last_route, max(created_at) AS last_message_at,
      trim(regexp_replace(coalesce(arg_min(content, seq) FILTER (role = 'user'), ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM messages GROUP BY 1),
      n AS (SELECT session_id, count(DISTINCT source) AS n FROM (SELECT session_id, unnest(source_keys) AS source FROM messages) GROUP BY 1)
    SELECT session_id, message_count, route_count, last_route, last_message_at, CASE WHEN q = '' THEN 'New session' WHEN length(q) <= 80 THEN q ELSE regexp_replace(substr(q, 1, 80), '\s\S*$', '') END AS title, coalesce(n, 0) AS source_count
    FROM f JOIN sessions USING (session_id) LEFT JOIN n USING (session_id) WHERE status = 'active' ORDER BY last_message_at DESC NULLS LAST, session_id LIMIT 50"""))
def sessions(spark, d):
    """The page of active sessions."""
    c = Corpus(spark, d)
    return conversation.sessions(c.messages, 50, c.sessions)


@query("c2_recent", with_corpus("messages", "SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq)::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS r FROM messages) WHERE r <= 4"))
def recent(spark, d):
    return conversation.recent(Corpus(spark, d).messages, 4).select("session_id", "seq", "position")


_SCOPED = "s AS (SELECT *, " + ", ".join(f"last_value({k if k.startswith('year') else f"nullif({k}, '')"} IGNORE NULLS) OVER w AS scope_{k}" for k in conversation.SCOPE_KEYS) + """ FROM messages
    WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("c3_scope", with_corpus("messages", _SCOPED + " SELECT session_id, seq, " + ", ".join(f"scope_{k}" for k in conversation.SCOPE_KEYS) + " FROM s"))
def scope(spark, d):
    """All eight inherited filters after each turn."""
    return conversation.scope(Corpus(spark, d).messages).select("session_id", "seq", *(f"scope_{k}" for k in conversation.SCOPE_KEYS))


def _own(k: str) -> str:
    return k if k.startswith("year") else f"nullif({k}, '')"


@query("c4_effective_filters", with_corpus("messages", _SCOPED + " SELECT session_id, seq, list_filter([" + ", ".join(f"CASE WHEN {_own(k)} IS NULL AND scope_{k} IS NOT NULL THEN '{k}' END" for k in conversation.SCOPE_KEYS)
       + "], lambda x: x IS NOT NULL) AS inherited, " + ", ".join(f"coalesce({_own(k)}, scope_{k}) AS effective_{k}" for k in conversation.SCOPE_KEYS) + " FROM s"))
def effective(spark, d):
    scoped = conversation.effective_filters(conversation.scope(Corpus(spark, d).messages))
    return scoped.select("session_id", "seq", "inherited", *(f"effective_{k}" for k in conversation.SCOPE_KEYS))


def _shown(text: str, most: int) -> str:
    one = f"trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return f"CASE WHEN length({one}) > {most} THEN rtrim(substr({one}, 1, {most - 1})) || '…' ELSE {one} END"


_LAST = "l AS (SELECT session_id, count(DISTINCT seq) AS messages_covered, " + ", ".join(f"arg_max({_own(k)}, seq) FILTER ({_own(k)} IS NOT NULL) AS {k}" for k in conversation.SCOPE_KEYS) + " FROM messages GROUP BY 1)"


def _scope_sql(labels: dict[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"'{labels[k]}=' || {k}" for k in conversation.SCOPE_KEYS) + ")"


_SUMMARIES = _LAST + f""", u AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM messages WHERE role = 'user'),
    a AS (SELECT session_id, max(CASE WHEN r = 1 THEN {_shown('content', 200)} END) AS latest, string_agg({_shown('content', 160)}, ' | ' ORDER BY r) FILTER (r BETWEEN 2 AND 7) AS before FROM u GROUP BY 1),
    sums AS (SELECT session_id, substr(concat_ws(chr(10), 'Latest: ' || latest, 'Scope: ' || nullif({_scope_sql({k: k for k in conversation.SCOPE_KEYS})}, ''), 'Earlier: ' || before), 1, 1200) AS summary, messages_covered FROM l LEFT JOIN a USING (session_id))"""


@query("c5_summary", with_corpus("messages", _SUMMARIES + " SELECT * FROM sums"))
def summaries(spark, d):
    return conversation.summaries(Corpus(spark, d).messages)


@query("c7_context", with_corpus("messages", _SUMMARIES + f""", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS r FROM messages),
    t AS (SELECT session_id, string_agg(CASE WHEN role = 'user' THEN '{conversation.USER_SPEAKS}' ELSE '{conversation.ASSISTANT_SPEAKS}' END || ': ' || {_shown("coalesce(content, '')", 200)}, chr(10) ORDER BY r DESC) AS turns FROM n WHERE r <= 6 GROUP BY 1)
    SELECT l.session_id, concat_ws(chr(10) || chr(10), '{conversation.SUMMARY_HEAD}' || chr(10) || nullif(trim(summary), ''), '{conversation.SCOPE_HEAD}' || chr(10) || nullif({_scope_sql(conversation.SCOPE_LABELS)}, ''),
      '{conversation.TURNS_HEAD}' || chr(10) || turns) AS context FROM l JOIN sums USING (session_id) LEFT JOIN t USING (session_id)"""))
def context(spark, d):
    """The prompt text of every session: summary, scope in its labels, newest turns."""
    m = Corpus(spark, d).messages
    return conversation.context(m, conversation.summaries(m))


@query("c8_upsert_summaries", with_corpus("messages", "n AS (SELECT session_id, count(DISTINCT seq) AS n FROM messages GROUP BY 1) SELECT session_id, CASE WHEN session_id % 3 = 0 THEN n ELSE n // 2 END AS messages_covered FROM n WHERE session_id % 5 > 0 OR session_id % 3 = 0"))
def upserted(spark, d):
    """Stored summaries of most sessions with those of every third one replaced or added."""
    n = Corpus(spark, d).messages.groupBy("session_id").agg(F.countDistinct("seq").alias("n"))
    stored = n.filter("session_id % 5 > 0").select("session_id", F.floor(F.col("n") / 2).alias("messages_covered"))
    return conversation.upsert_summaries(stored, n.filter("session_id % 3 = 0").select("session_id", F.col("n").alias("messages_covered")))


@query("c9_stale", with_corpus("messages", "SELECT session_id, count(DISTINCT seq) // 2 AS messages_covered, count(DISTINCT seq) AS messages FROM messages GROUP BY 1 HAVING count(DISTINCT seq) // 2 < count(DISTINCT seq)"))
def stale(spark, d):
    m = Corpus(spark, d).messages
    stored = m.groupBy("session_id").agg(F.floor(F.countDistinct("seq") / 2).alias("messages_covered"))
    return conversation.stale(stored, m)


@query("n10_answer_batch")
def answers(spark, d):
    """Answers to the questions of every order; the tests hold its parts and its statuses against plain loops."""
    from lodestone.plans import research
    from lodestone.plans.answer_batch import answer_batch

    c, topics_of, names = research.assigned(spark, d)
    topics_of = written(topics_of, "assigned")
    evolved = topics.evolution(topics.topic_years(c.dated, topics_of, names, research.LOW, research.HIGH), research.LOW)
    scores = topics.scored(topics.author_topics(c, topics_of, research.RECENT))
    return answer_batch(c, question_table(spark, d), lambda nodes: graph.edges_of(c.author_lines, "publication_id", "author_id", nodes, 2), evolved, research.terms(spark), topics_of, scores, vector.hashing_encoder(64), 64)
