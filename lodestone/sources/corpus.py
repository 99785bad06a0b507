"""The research corpus as a bundle of DataFrames, and its adapter from star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class Corpus:
    """Tables of a corpus, each made when first asked for.

    publications: publication_id, eid, doi, title, year, source_title, citation_count, document_type
    authors: author_id, author_name, author_name_normalized       pub_author: publication_id, author_id, author_order
    institutions: institution_id, institution_name, city, country, institution_name_normalized
    pub_institution: publication_id, institution_id               keywords: publication_id, keyword_id, keyword, keyword_type
    funding: funding_id, publication_id, funding_agency           references: publication_id, reference_order, reference_text
    chunks: chunk_id, publication_id, chunk_text, embedding, label
    """

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    @cached_property
    def publications(self) -> DataFrame:
        return self._titled(self._table("orders"), self._table("lineitem"))

    def publications_of(self, some: DataFrame) -> DataFrame:
        """The publications that some (publication_id) names. No other's lines and titles are looked up."""
        ids = some.select("publication_id").distinct()
        return self._titled(*(self._table(t).join(ids, F.col(k).cast("string") == F.col("publication_id"), "left_semi") for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))))

    def _titled(self, orders: DataFrame, lines: DataFrame) -> DataFrame:
        lines = lines.select("l_orderkey", "l_linenumber", "l_partkey").join(self._table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        titles = lines.groupBy("l_orderkey").agg(F.min_by("p_name", F.struct("l_linenumber", "l_partkey")).alias("title"))
        o = orders.join(titles, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return o.select(*self._of_orders(), "title").select("publication_id", "eid", "doi", "title", "year", "source_title", "citation_count", "document_type")

    @cached_property
    def dated(self) -> DataFrame:
        """Publications without their titles, which take joins."""
        return self._table("orders").select(*self._of_orders())

    @staticmethod
    def _of_orders() -> list[Column]:
        key = F.col("o_orderkey").cast("string")
        return [
            key.alias("publication_id"),
            F.concat(F.lit("2-s2.0-"), key).alias("eid"),
            F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("10.1000/"), key)).alias("doi"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderstatus").alias("source_title"),
            F.floor(F.col("o_totalprice") / 10000).cast("int").alias("citation_count"),
            F.col("o_orderpriority").alias("document_type"),
        ]

    @cached_property
    def authors(self) -> DataFrame:
        name = F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"))
        return self._table("part").select(F.col("p_partkey").cast("string").alias("author_id"), name.alias("author_name"), F.lower(name).alias("author_name_normalized"))

    @cached_property
    def pub_author(self) -> DataFrame:
        lines = self._table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("author_order"))
        return lines.select(F.col("l_orderkey").cast("string").alias("publication_id"), F.col("l_partkey").cast("string").alias("author_id"), "author_order")

    @cached_property
    def author_lines(self) -> DataFrame:
        """publication_id and author_id of pub_author without its order, and with repeats."""
        return self._table("lineitem").select(F.col("l_orderkey").cast("string").alias("publication_id"), F.col("l_partkey").cast("string").alias("author_id"))

    @cached_property
    def institutions(self) -> DataFrame:
        s = self._table("supplier").join(self._table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").cast("string").alias("institution_id"), F.col("s_name").alias("institution_name"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.lower("s_name").alias("institution_name_normalized"))

    @cached_property
    def pub_institution(self) -> DataFrame:
        return self._table("lineitem").select(F.col("l_orderkey").cast("string").alias("publication_id"), F.col("l_suppkey").cast("string").alias("institution_id")).distinct()

    @cached_property
    def institution_lines(self) -> DataFrame:
        """pub_institution with repeats."""
        return self._table("lineitem").select(F.col("l_orderkey").cast("string").alias("publication_id"), F.col("l_suppkey").cast("string").alias("institution_id"))

    @cached_property
    def keyword_lines(self) -> DataFrame:
        """publication_id, keyword and keyword_type of keywords, with repeats."""
        lines = self._table("lineitem").select("l_orderkey", "l_partkey").join(self._table("part"), F.col("l_partkey") == F.col("p_partkey"))
        kinds = F.explode(F.array(F.struct(F.lower("p_type").alias("keyword"), F.lit("index").alias("keyword_type")), F.struct(F.lower("p_brand").alias("keyword"), F.lit("author").alias("keyword_type"))))
        return lines.select(F.col("l_orderkey").cast("string").alias("publication_id"), kinds.alias("k")).select("publication_id", "k.*")

    @cached_property
    def keywords(self) -> DataFrame:
        return self.keyword_lines.distinct().withColumn("keyword_id", F.concat_ws(":", "keyword_type", "keyword"))

    @cached_property
    def funding(self) -> DataFrame:
        o = self._table("orders").filter("o_orderkey % 3 = 0").join(self._table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return o.select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("funding_id"), F.col("o_orderkey").cast("string").alias("publication_id"), F.col("c_mktsegment").alias("funding_agency"))

    @cached_property
    def chunks(self) -> DataFrame:
        e = self._table("embeddings").join(self._table("documents").select("doc_id", F.col("text").alias("chunk_text")), F.col("vec_id") == F.col("doc_id"), "left")
        return e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("publication_id"), "chunk_text", "embedding", "label")

    @cached_property
    def messages(self) -> DataFrame:
        """Transcript rows: session_id, seq, role, content, created_at, route and inherited filters by fixed rules."""
        c = self._table("conversations")
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60)
        routes = F.array(*(F.lit(x) for x in ("sql", "vector", "graph", "hybrid")))
        return c.select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), at.alias("created_at"),
            F.when(F.col("role") == "assistant", F.element_at(routes, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))).alias("route"),
            F.when(F.col("turn") % 4 == 0, F.concat(F.lit("country-"), (F.col("conv_id") % 5).cast("string"))).alias("country"),
            F.when(F.col("turn") % 6 == 0, F.concat(F.lit("topic-"), (F.col("turn") % 3).cast("string"))).alias("topic_name"),
            F.when(F.col("turn") % 5 == 1, F.concat(F.lit("author-"), (F.col("conv_id") % 7).cast("string"))).alias("author_name"),
            F.when(F.col("turn") % 7 == 2, F.concat(F.lit("institution-"), (F.col("conv_id") % 3).cast("string"))).when(F.col("turn") % 7 == 5, "").alias("institution_name"),
            F.when(F.col("turn") % 9 == 4, F.concat(F.lit("keyword-"), (F.col("turn") % 4).cast("string"))).alias("keyword"),
            F.when(F.col("turn") % 8 == 3, "Article").alias("document_type"),
            F.when(F.col("turn") % 10 == 6, 2000 + F.col("conv_id") % 20).cast("int").alias("year_from"),
            F.when(F.col("turn") % 10 == 7, 2020 + F.col("conv_id") % 5).cast("int").alias("year_to"),
            F.when(F.col("role") == "assistant", F.array(
                F.struct(((F.col("conv_id") + F.col("turn")) % 6).cast("string").alias("publication_id"), F.lit("10.1000/x").alias("doi"), F.lit("First").alias("title")),
                F.struct(F.lit(None).cast("string").alias("publication_id"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("10.1000/"), (F.col("turn") % 4).cast("string"))).alias("doi"), F.concat(F.lit("Title "), (F.col("turn") % 5).cast("string")).alias("title")),
            )).alias("sources"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """session_id and its status: every seventh is archived."""
        return self._table("conversations").select(F.col("conv_id").alias("session_id"), F.when(F.col("conv_id") % 7 == 0, "archived").otherwise("active").alias("status")).distinct()


#: The same tables as DuckDB common table expressions over the same files.
CORPUS_SQL = {
    "publications": """publications AS (SELECT o_orderkey::VARCHAR AS publication_id, '2-s2.0-' || o_orderkey AS eid,
        CASE WHEN o_orderkey % 5 <> 0 THEN '10.1000/' || o_orderkey END AS doi, t.title, year(o_orderdate)::INT AS year, o_orderstatus AS source_title,
        floor(o_totalprice / 10000)::INT AS citation_count, o_orderpriority AS document_type
        FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(p_name, {'a': l_linenumber, 'b': l_partkey}) AS title FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) t ON o_orderkey = t.l_orderkey)""",
    "authors": "authors AS (SELECT p_partkey::VARCHAR AS author_id, p_name || ' #' || p_partkey AS author_name, lower(p_name || ' #' || p_partkey) AS author_name_normalized FROM part)",
    "pub_author": "pub_author AS (SELECT l_orderkey::VARCHAR AS publication_id, l_partkey::VARCHAR AS author_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY l_orderkey, l_partkey)",
    "institutions": "institutions AS (SELECT s_suppkey::VARCHAR AS institution_id, s_name AS institution_name, n_name AS city, r_name AS country, lower(s_name) AS institution_name_normalized FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "pub_institution": "pub_institution AS (SELECT DISTINCT l_orderkey::VARCHAR AS publication_id, l_suppkey::VARCHAR AS institution_id FROM lineitem)",
    "keywords": "keywords AS (SELECT DISTINCT l_orderkey::VARCHAR AS publication_id, lower(p_type) AS keyword, 'index' AS keyword_type FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT l_orderkey::VARCHAR, lower(p_brand), 'author' FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "funding": "funding AS (SELECT 'F' || o_orderkey AS funding_id, o_orderkey::VARCHAR AS publication_id, c_mktsegment AS funding_agency FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0)",
    "chunks": "chunks AS (SELECT vec_id AS chunk_id, vec_id // 2 AS publication_id, d.text AS chunk_text, embedding, label FROM embeddings LEFT JOIN documents d ON vec_id = d.doc_id)",
    "messages": """messages AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content, to_timestamp(1704067200 + turn * 60)::TIMESTAMP AS created_at,
        CASE WHEN role = 'assistant' THEN ['sql', 'vector', 'graph', 'hybrid'][((conv_id + turn) % 4 + 1)::INT] END AS route,
        CASE WHEN turn % 4 = 0 THEN 'country-' || (conv_id % 5) END AS country, CASE WHEN turn % 6 = 0 THEN 'topic-' || (turn % 3) END AS topic_name,
        CASE WHEN turn % 5 = 1 THEN 'author-' || (conv_id % 7) END AS author_name, CASE WHEN turn % 7 = 2 THEN 'institution-' || (conv_id % 3) WHEN turn % 7 = 5 THEN '' END AS institution_name,
        CASE WHEN turn % 9 = 4 THEN 'keyword-' || (turn % 4) END AS keyword, CASE WHEN turn % 8 = 3 THEN 'Article' END AS document_type,
        CASE WHEN turn % 10 = 6 THEN 2000 + conv_id % 20 END::INT AS year_from, CASE WHEN turn % 10 = 7 THEN 2020 + conv_id % 5 END::INT AS year_to,
        CASE WHEN role = 'assistant' THEN [((conv_id + turn) % 6)::VARCHAR, coalesce(CASE WHEN turn % 3 = 0 THEN '10.1000/' || (turn % 4) END, 'Title ' || (turn % 5))] END AS source_keys FROM conversations)""",
    "sessions": "sessions AS (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status FROM conversations)",
}


def with_corpus(names: str, body: str) -> str:
    """A DuckDB statement over the named corpus tables; body starts with further expressions ('x AS (...),') or SELECT."""
    return "WITH RECURSIVE " + ",\n".join(CORPUS_SQL[n] for n in names.split()) + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
