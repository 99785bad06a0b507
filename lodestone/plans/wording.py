"""Questions in two languages, with given filters; their SQL is a table of readings made by hand, not the patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import questions
from lodestone.sources.corpus import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Wordings whose intent is given, each of which must go to the tables.
INTENT_WORDINGS = {
    "count": ["Berapa publikasi?", "Berapa jumlah publikasi tahun %d?", "total publikasi", "total paper", "jumlah paper", "how many publications", "count of publications"],
    "funding": ["Berapa grant yang diberikan?", "jumlah grant", "how many grants"],
    "top_institutions": ["Top 5 institutions", "Top 5 institution", "top institutions", "institutions teratas", "top institusi", "most productive institution"],
    "top_authors": ["penulis paling produktif", "most productive author", "top author", "penulis teratas", "author paling produktif", "most prolific author", "top 5 researchers by publication count", "Which author has the highest publication count?"],
    "most_cited": ["sitasi terbanyak", "most cited", "most citations", "highest citation", "paling banyak disitasi", "Which author has the most citations?"],
    "average_citations": ["average citation count per publication", "Berapa rata-rata sitasi per publikasi?"],
    "list": ["daftar publikasi", "list publications", "show publications", "tampilkan publikasi", "artikel pada tahun", "paper in year", "List publications in %d"],
}
#: Wording, given topic, given country, route, reason, year operator (of %d), topic words.
ROUTE_WORDINGS = [
    ("Siapa yang sudah bekerja dengan Universitas Indonesia?", None, None, "graph", "pattern", None, None),
    ("jaringan kolaborasi sejak tahun %d", None, None, "graph", "pattern", "gte", None),
    ("who has worked with Sari?", "widgets", None, "graph", "pattern", None, "widgets"),
    ("tren topik Coumarin setelah %d", None, None, "hybrid", "pattern", "gte", "Coumarin"),
    ("How has research on Stem Cells & Inflammation evolved over time?", None, None, "hybrid", "pattern", None, "Stem Cells & Inflammation"),
    ("siapa pakar terbaik bidang biokimia sebelum %d?", None, None, "hybrid", "pattern", "lte", "biokimia"),
    ("What are emerging therapy topics after %d and who are the experts?", None, None, "hybrid", "pattern", "gte", None),
    ("top 3 topics", None, None, "hybrid", "pattern", None, None),
    ("growth of this field", "widgets", None, "hybrid", "filters", None, "widgets"),
    ("growth of this field", "", None, "vector", "fallback", None, None),
    ("papers by everyone", None, "ASIA", "sql", "filters", None, None),
    ("papers by everyone", None, None, "vector", "fallback", None, None),
    ("siapa saja?", None, "ASIA", "sql", "filters", None, None),
    ("artikel yang membahas tanah antara %d dan 2001", None, None, "vector", "pattern", "between", None),
    ("effect of heat", None, None, "vector", "pattern", None, None),
    ("hello", "widgets", None, "hybrid", "fallback", None, "widgets"),
    ("hello", None, "ASIA", "vector", "fallback", None, None),
    (None, None, None, "vector", "fallback", None, None),
]


def _wordings() -> list[tuple]:
    """(wording, topic, country, route, reason, intent, year operator, topic words) of every case."""
    out = []
    for intent, wordings in INTENT_WORDINGS.items():
        out += [(w, None, None, "sql", "pattern", intent, "eq" if "%d" in w else None, None) for w in wordings]
    return out + [(w, topic, country, route, reason, None, op, words) for w, topic, country, route, reason, op, words in ROUTE_WORDINGS]


def worded_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for every order, its wording by the order's key and its year by the order's date; topic_name and country are given filters."""
    cases = [(i, w, topic, country) for i, (w, topic, country, *_) in enumerate(_wordings())]
    table = F.broadcast(spark.createDataFrame(cases, "case_key long, wording string, topic_name string, country string"))  # as long as the list above
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate").join(table, F.col("o_orderkey") % len(cases) == F.col("case_key"))
    return o.select(F.col("o_orderkey").alias("question_id"), F.replace("wording", F.lit("%d"), F.year("o_orderdate").cast("string")).alias("question"), "topic_name", "country")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql() -> str:
    rows = ", ".join(f"({i}, {', '.join(_text(x) for x in case)})" for i, case in enumerate(_wordings()))
    return f"""WITH g(k, w, t, c, route, route_reason, intent, op, topic_words) AS (VALUES {rows}), o AS (SELECT o_orderkey AS question_id, year(o_orderdate)::INT AS y, g.* FROM orders JOIN g ON k = o_orderkey % {len(_wordings())})
        SELECT question_id, replace(w, '%d', y::VARCHAR) AS question, route, route_reason, intent::VARCHAR AS intent, op::VARCHAR AS year_op, topic_words::VARCHAR AS topic_words,
          CASE op WHEN 'between' THEN least(y, 2001) WHEN 'gte' THEN y WHEN 'eq' THEN y END::INT AS year_from, CASE op WHEN 'between' THEN greatest(y, 2001) WHEN 'lte' THEN y WHEN 'eq' THEN y END::INT AS year_to FROM o"""


def wording(spark: SparkSession, d: str) -> DataFrame:
    """Route, reason, intent, years and topic of every order's question."""
    read = questions.read(worded_questions(spark, d), filters=["topic_name", "country"])
    return read.select("question_id", "question", "route", "route_reason", "intent", "year_op", "topic_words", "year_from", "year_to")


QUERIES["n3_wording"] = wording
ORACLE_SQL["n3_wording"] = _sql()
