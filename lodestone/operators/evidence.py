"""Evidence rows from results, their merging and ranking, and the verification of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import citation, confidence, normalize_title, plain_number, tidy, token_overlap

SOURCE = "publication_id", "title", "year", "doi", "relevance"


def evidence(df: DataFrame, question, claim, metric: str, value, period="all-time", sources=None, conf=None) -> DataFrame:
    """The common shape: question_id, claim, metric, value_num, value_str, period, sources, confidence."""
    empty = F.array().cast("array<struct<publication_id:string,title:string,year:int,doi:string,relevance:double>>")
    number = value.cast("double") if value is not None else F.lit(None).cast("double")
    return df.select(question.alias("question_id"), claim.alias("claim"), F.lit(metric).alias("metric"), number.alias("value_num"), (value.cast("string") if value is not None else F.lit(None).cast("string")).alias("value_str"), (F.lit(period) if isinstance(period, str) else period).alias("period"), (empty if sources is None else sources).alias("sources"), (F.lit(1.0) if conf is None else conf).alias("confidence"))


def from_count(df: DataFrame, value: str, what: str = "publications") -> DataFrame:
    """A scalar count per question; 0 gives no evidence (see zero_class)."""
    return evidence(df.filter(F.col(value) > 0), F.col("question_id"), F.format_string(f"There are %d {what}", F.col(value).cast("long")), "count", F.col(value))


def zero_class(df: DataFrame, value: str) -> DataFrame:
    return df.select("question_id", F.when(F.coalesce(F.col(value), F.lit(0)) == 0, "zero_aggregate").alias("zero_evidence_class"))


def from_ranking(df: DataFrame, name: str, value: str, what: str) -> DataFrame:
    return evidence(df, F.col("question_id"), F.format_string(f"%s has %d {what}", F.col(name), F.col(value).cast("long")), f"{value}_ranking", F.col(value))


def _source(relevance):
    return F.array(F.struct(F.col("publication_id").cast("string").alias("publication_id"), "title", F.col("year").cast("int").alias("year"), "doi", relevance.alias("relevance")))


def from_publications(df: DataFrame) -> DataFrame:
    """Listed publications: claim is the citation, value the citations."""
    return evidence(df, F.col("question_id"), citation(F.col("title"), F.col("year"), F.col("doi")), "citation_count", F.col("citation_count"), F.coalesce(F.col("year").cast("string"), F.lit("all-time")), _source(F.lit(1.0)))


def from_matches(df: DataFrame) -> DataFrame:
    """Vector matches joined with their publications: value and confidence are the similarity."""
    s = F.round("similarity", 4)
    return evidence(df, F.col("question_id"), citation(F.col("title"), F.col("year"), F.col("doi")), "similarity", s, F.coalesce(F.col("year").cast("string"), F.lit("all-time")), _source(s), confidence(F.col("similarity")))


def from_edges(edges: DataFrame, publications: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Graph edges (question_id, node, partner, weight, via) with the publications behind them; and how many edges had none."""
    each = edges.select("question_id", "node", "partner", "weight", F.explode_outer("via").alias("publication_id"))
    known = each.join(publications.select("publication_id", "title", "year", "doi"), "publication_id", "left")
    item = F.when(F.col("title").isNotNull() | F.col("year").isNotNull(), F.struct("publication_id", "title", F.col("year").cast("int").alias("year"), "doi", F.lit(1.0).alias("relevance")))
    rows = known.groupBy("question_id", "node", "partner", "weight").agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("sources"))
    claim = F.format_string("%s and %s share %d publications", "node", "partner", F.col("weight").cast("long"))
    dropped = rows.groupBy("question_id").agg(F.count_if(F.size("sources") == 0).alias("dropped"))
    return evidence(rows.filter(F.size("sources") > 0), F.col("question_id"), claim, "collaboration_weight", F.col("weight"), sources=F.col("sources")), dropped


def from_trends(df: DataFrame) -> DataFrame:
    return evidence(df, F.col("question_id"), F.format_string("%s grew by %s in %d", "topic_name", plain_number(F.col("growth_score")), F.col("year").cast("long")), "growth_score", F.col("growth_score"), F.col("year").cast("string"))


def from_experts(df: DataFrame) -> DataFrame:
    return evidence(df, F.col("question_id"), F.format_string("%s scores %s", "author_name", plain_number(F.col("expertise_score"))), "expertise_score", F.col("expertise_score"))


def from_analytics(df: DataFrame) -> DataFrame:
    """Rows of any analytics table (question_id, period, author_name, expertise_score, topic_name, growth_score; null where a row lacks them).

    A row with an author and an expertise score is evidence of expertise, else one with a topic and a growth score of growth; other rows are none.
    """
    expert = F.col("author_name").isNotNull() & F.col("expertise_score").isNotNull()
    grown = ~expert & F.col("topic_name").isNotNull() & F.col("growth_score").isNotNull()
    topic, period = F.coalesce("topic_name", F.lit("a related topic")), F.coalesce("period", F.lit("all-time"))
    said = evidence(df.filter(expert), F.col("question_id"), F.format_string("%s scores %s in %s (%s)", F.col("author_name"), plain_number(F.col("expertise_score")), topic, period), "expertise_score", F.col("expertise_score"), period)
    rose = evidence(df.filter(grown), F.col("question_id"), F.format_string("%s grew by %s (%s)", F.col("topic_name"), plain_number(F.col("growth_score")), period), "growth_score", F.col("growth_score"), period)
    return said.unionByName(rose)


def ordered_distinct(df: DataFrame, value: str, out: str) -> DataFrame:
    """(question_id, out): the distinct values of each question in the order of their first position; null and blank ones are left out."""
    first = df.filter(F.coalesce(F.trim(value), F.lit("")) != "").groupBy("question_id", F.col(value).alias("value")).agg(F.min("position").alias("position"))
    return first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias(out))


def unify(claims: DataFrame, sources: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The evidence of all routes as one set for each question: claims ranked, sources ranked, and ignored filters and lineage.

    claims: rows as evidence() makes them. sources: question_id, position, publication_id, title, year, doi, relevance, provenance. notes:
    question_id, position (with the place in its list within a route's), ignored, lineage. Equal claims are one, as are sources of one publication;
    notes keep the order of routes. Questions that only one of the three has are in that one.
    """
    ignored, lineage = ordered_distinct(notes, "ignored", "filters_ignored"), ordered_distinct(notes, "lineage", "lineage")
    asked = notes.select("question_id").distinct().join(ignored, "question_id", "left").join(lineage, "question_id", "left")
    told = asked.select("question_id", F.coalesce("filters_ignored", F.array().cast("array<string>")).alias("filters_ignored"), F.array_join("lineage", "; ").alias("lineage"))
    return rank_evidence(merge_evidence(claims)), rank_sources(merge_sources(sources)), told


def merge_sources(df: DataFrame) -> DataFrame:
    """(question_id, publication_id): greatest relevance, first known title, year and doi by position, provenance in order. df has position, provenance."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c) for c in ("title", "year", "doi")]
    provenance = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "provenance"))), lambda s: s["provenance"])), "; ")
    return df.groupBy("question_id", "publication_id").agg(F.max("relevance").alias("relevance"), *first, provenance.alias("provenance"))


def merge_evidence(df: DataFrame) -> DataFrame:
    """Equal claims of a question are one: greatest confidence, sources without repeats of an id."""
    rows = df.groupBy("question_id", "metric", "claim", "value_str", "period").agg(F.max("value_num").alias("value_num"), F.max("confidence").alias("confidence"), F.flatten(F.collect_list("sources")).alias("all"))
    ids = F.array_sort(F.array_distinct(F.transform("all", lambda s: s["publication_id"])))
    one = F.transform(ids, lambda i: F.try_element_at(F.array_sort(F.filter("all", lambda s: s["publication_id"] == i)), F.lit(1)))
    return rows.withColumn("sources", one).drop("all")


def rank_evidence(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("confidence"), F.desc_nulls_last("value_num"), "metric", "claim")
    return df.withColumn("rank", F.row_number().over(w))


def rank_sources(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), F.desc(F.coalesce("year", F.lit(0))), F.coalesce("title", F.lit("")), "publication_id")
    return df.withColumn("rank", F.row_number().over(w))


def merge_items(df: DataFrame) -> DataFrame:
    """Items by (question_id, source_type, source_id): longest content, greatest scores, all provenance, metadata where the earlier value wins."""
    pairs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.map_entries("metadata").alias("m")))), lambda s: s["m"]))
    out = df.groupBy("question_id", "source_type", "source_id").agg(F.max_by("content", F.struct(F.length("content"), -F.col("position"))).alias("content"), F.max("score").alias("score"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance_ids")))).alias("provenance_ids"), pairs.alias("pairs"))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["key"]))
    return out.withColumn("metadata", F.map_from_entries(F.transform(keys, lambda k: F.try_element_at(F.filter("pairs", lambda p: p["key"] == k), F.lit(1))))).drop("pairs")


def rank_items(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("confidence"), F.desc_nulls_last("year"), "title", "source_id")
    return df.withColumn("rank", F.row_number().over(w))


#: A citation in an answer.
CITATION = r"\[([^\[\]]+?),\s*(\d{4}|n\.d\.),\s*([^\[\],]+)\]"


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, place, title, year, doi, mark) of every citation in answers (answer_id, text)."""
    marks = F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), 0))
    rows = answers.select("answer_id", marks.alias("place", "mark"))
    part = [F.regexp_extract("mark", CITATION, g) for g in (1, 2, 3)]
    return rows.select("answer_id", "place", "mark", F.trim(part[0]).alias("title"), part[1].alias("year"), F.trim(part[2]).alias("doi"))


def verify_citations(answers: DataFrame, sources: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Citations with `verified`, and the answers without those that no source bears out.

    A citation stands if doi (when it gives one), title (equal or overlapping by `least`) and year agree
    with the same source of its answer (answer_id, title, year, doi).
    """
    found = citations(answers)
    s = sources.select("answer_id", F.col("title").alias("s_title"), F.col("year").alias("s_year"), F.col("doi").alias("s_doi"))
    a, b = normalize_title(F.col("title")), normalize_title(F.coalesce("s_title", F.lit("Untitled")))
    year = F.when(F.col("year") == "n.d.", F.col("s_year").isNull()).otherwise(F.col("s_year").isNull() | (F.col("year") == F.col("s_year").cast("string")))
    doi = (F.lower("doi") == "no-doi") | (F.lower("doi") == F.lower("s_doi"))
    good = ((a == b) | (token_overlap(a, b) >= least)) & year & F.coalesce(doi, F.lit(False))
    checked = found.join(s, "answer_id", "left").groupBy("answer_id", "place", "mark", "title", "year", "doi").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("verified"))
    bad = checked.filter("NOT verified").groupBy("answer_id").agg(F.array_sort(F.collect_set("mark")).alias("bad"))
    text = F.when(F.col("bad").isNull(), F.col("text")).otherwise(tidy(F.aggregate("bad", F.col("text"), lambda t, m: F.replace(t, m, F.lit("")))))
    return checked, answers.join(bad, "answer_id", "left").select("answer_id", text.alias("text"))


def answer_text(ranked: DataFrame, most: int = 10) -> DataFrame:
    """Numbered claims of each question with the citation of their first source."""
    src = F.try_element_at("sources", F.lit(1))
    cited = F.when(F.size("sources") > 0, F.concat(F.lit(" "), citation(src["title"], src["year"], src["doi"]))).otherwise("")
    line = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("claim"), cited).alias("line"))
    return ranked.filter(F.col("rank") <= most).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n\n").alias("answer"))


def context_block(ranked_sources: DataFrame, most: int = 20) -> DataFrame:
    """One text for each question: its ranked sources as numbered lines with score and provenance."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(F.col("title"), F.col("year"), F.col("doi")))
    line = F.concat_ws(" | ", head, F.format_string("score %.4f", F.coalesce("relevance", F.lit(0.0))), F.concat(F.lit("from "), F.col("provenance")))
    rows = ranked_sources.filter(F.col("rank") <= most)
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("context"))
