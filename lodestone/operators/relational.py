"""Counts, rankings and listings over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import clamped, icontains, year_pred
from lodestone.operators.spread import exact_quantiles, spread_join
from lodestone.sources.corpus import Corpus
from lodestone.sources.shared import written

#: Asks of one country that its publications meet as one row, about.
ASKS_LISTED = 1000


def in_country(c: Corpus, country: str) -> DataFrame:
    """Publication ids with an institution in the country, for semi-joins."""
    return c.pub_institution.join(c.institutions.filter(F.lower("country") == country.lower()), "institution_id").select("publication_id")


def members(c: Corpus, asks: DataFrame) -> DataFrame:
    """(ask_id, publication_id): the publications that meet every membership an ask sets.

    asks has ask_id, author_id, institution_id and country (in any case); null sets none. An ask that
    sets nothing narrows nothing and has no rows; repeated asks count once. An ask looks up the first
    membership that it sets, where a country of many publications is dealt in pieces, and the others are
    then tested by publication. What is shuffled grows with the memberships, not with the rows of the result.
    """
    asks = asks.select("ask_id", "author_id", "institution_id", F.lower("country").alias("country")).distinct()
    countries = c.institutions.select("institution_id", F.lower("country").alias("country"))
    places = written(c.pub_institution.select("publication_id", "institution_id").distinct(), "places")
    sides = {
        "author_id": c.pub_author.select("publication_id", "author_id").distinct(),
        "institution_id": places,
        "country": written(places.join(countries, "institution_id").select("publication_id", "country").distinct(), "countries"),
    }
    found, unset = None, F.lit(True)
    for column in ("author_id", "institution_id"):
        each = spread_join(asks.filter(unset & F.col(column).isNotNull()), sides[column], [column])
        found = each if found is None else found.unionByName(each)
        unset = unset & F.col(column).isNull()
    for column in ("institution_id", "country"):
        met = sides[column].withColumn("_met", F.lit(True))
        found = found.join(met, ["publication_id", column], "left").filter(F.col(column).isNull() | F.col("_met")).drop("_met")
    # Asks of a country alone have nothing left to be tested. They meet its publications in lists of ASKS_LISTED, and
    # rows of one ask and one publication are only made after the last shuffle.
    alone = asks.filter(unset & F.col("country").isNotNull()).select("country", "ask_id")
    sizes = alone.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / ASKS_LISTED).alias("lists"))
    lists = alone.join(sizes, "country").groupBy("country", F.pmod(F.xxhash64("ask_id"), F.col("lists")).alias("list")).agg(F.collect_list("ask_id").alias("asks")).drop("list")
    wide = spread_join(lists, sides["country"], ["country"]).select(F.explode("asks").alias("ask_id"), "publication_id")
    return found.select("ask_id", "publication_id").unionByName(wide)


def top_authors(c: Corpus, n: int | None = None, country: str | None = None, op: str | None = None, year: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Authors by distinct publications, most first, then by name and id."""
    pubs = c.publications.filter(year_pred(F.col("year"), op, year, low, high)).select("publication_id")
    if country is not None:
        pubs = pubs.join(in_country(c, country), "publication_id", "left_semi")
    counted = c.pub_author.join(pubs, "publication_id").groupBy("author_id").agg(F.countDistinct("publication_id").alias("publication_count"))
    return counted.join(c.authors.select("author_id", "author_name"), "author_id").orderBy(F.desc("publication_count"), "author_name", "author_id").limit(clamped(n, 10))


def top_institutions(c: Corpus, n: int | None = None, country: str | None = None) -> DataFrame:
    places = c.institutions if country is None else c.institutions.filter(F.lower("country") == country.lower())
    counted = c.pub_institution.groupBy("institution_id").agg(F.countDistinct("publication_id").alias("publication_count"))
    return counted.join(places.select("institution_id", "institution_name"), "institution_id").orderBy(F.desc("publication_count"), "institution_name", "institution_id").limit(clamped(n, 10))


def count_publications(c: Corpus, op: str | None = None, year: int | None = None, author: str | None = None, institution: str | None = None) -> DataFrame:
    """One row: distinct publications within a year, an author's name and an institution's name (parts of them)."""
    pubs = c.publications.filter(year_pred(F.col("year"), op, year)).select("publication_id")
    if author is not None:
        pubs = pubs.join(c.pub_author.join(c.authors.filter(icontains(F.col("author_name"), author)), "author_id"), "publication_id", "left_semi")
    if institution is not None:
        pubs = pubs.join(c.pub_institution.join(c.institutions.filter(icontains(F.col("institution_name"), institution)), "institution_id"), "publication_id", "left_semi")
    return pubs.agg(F.countDistinct("publication_id").alias("total_publications"))


def average_citations(c: Corpus, op: str | None = None, year: int | None = None) -> DataFrame:
    pubs = c.publications.filter(year_pred(F.col("year"), op, year))
    return pubs.agg(F.coalesce(F.round(F.avg("citation_count"), 2), F.lit(0.0)).alias("avg_citations"), F.countDistinct("publication_id").alias("total_publications"))


def funding_totals(c: Corpus, op: str | None = None, year: int | None = None, institution: str | None = None) -> DataFrame:
    """One row: distinct grants and distinct funded publications."""
    funded = c.funding.join(c.publications.filter(year_pred(F.col("year"), op, year)).select("publication_id"), "publication_id")
    if institution is not None:
        funded = funded.join(c.pub_institution.join(c.institutions.filter(icontains(F.col("institution_name"), institution)), "institution_id"), "publication_id", "left_semi")
    return funded.agg(F.countDistinct("funding_id").alias("total_grants"), F.countDistinct("publication_id").alias("total_publications"))


def keyword_institutions(c: Corpus, keyword: str) -> DataFrame:
    """Institutions by distinct publications with a keyword that contains the term, with the sorted ids of all those."""
    pubs = c.keywords.filter(icontains(F.col("keyword"), keyword)).select("publication_id").distinct()
    hits = c.pub_institution.join(pubs, "publication_id").groupBy("institution_id").agg(F.countDistinct("publication_id").alias("publication_count"), F.sort_array(F.collect_set("publication_id")).alias("via_publication_ids"))
    return hits.join(c.institutions.select("institution_id", "institution_name"), "institution_id")


def author_counts(c: Corpus) -> DataFrame:
    """Every author with the number of publications, 0 for none."""
    return c.authors.join(c.pub_author.groupBy("author_id").agg(F.countDistinct("publication_id").alias("n")), "author_id", "left").select("author_id", "author_name", F.coalesce("n", F.lit(0)).alias("publication_count"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key is not in parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def most_cited(c: Corpus, n: int | None = None, op: str | None = None, year: int | None = None) -> DataFrame:
    cited = c.publications.filter(year_pred(F.col("year"), op, year))
    return cited.select("publication_id", "title", "year", "citation_count").orderBy(F.desc_nulls_last("citation_count"), F.asc_nulls_last("title"), "publication_id").limit(clamped(n, 10))


def list_publications(c: Corpus, n: int | None = None, op: str | None = None, year: int | None = None, author: str | None = None) -> DataFrame:
    pubs = c.publications.filter(year_pred(F.col("year"), op, year))
    if author is not None:
        pubs = pubs.join(c.pub_author.join(c.authors.filter(icontains(F.col("author_name"), author)), "author_id"), "publication_id", "left_semi")
    return pubs.select("publication_id", "title", "year", "source_title", "citation_count").orderBy(F.desc_nulls_last("citation_count"), F.asc_nulls_last("title"), "publication_id").limit(clamped(n, 10))


def year_histogram(c: Corpus) -> DataFrame:
    """Publications, their share and mean citations by year."""
    by_year = c.publications.groupBy("year").agg(F.count(F.lit(1)).alias("publication_count"), F.round(F.avg("citation_count"), 4).alias("mean_citations"))
    total = by_year.agg(F.sum("publication_count").alias("total"))
    return by_year.crossJoin(F.broadcast(total)).select("year", "publication_count", "mean_citations", F.round(F.col("publication_count") / F.col("total"), 6).alias("share"))


def source_types(sources: DataFrame, key: str) -> DataFrame:
    """Sources of each type in an answer (key), and their share of the answer's sources; counted by key and type before the shares are taken."""
    n = sources.groupBy(key, "source_type").agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(key)), 6))


def relevance_by_year(sources: DataFrame, key: str) -> DataFrame:
    """Sources and their mean relevance for each year of an answer (key); sources without a year are left out."""
    return sources.filter("year is not null").groupBy(key, "year").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("relevance"), 6).alias("mean_relevance"))


def value_top(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The most frequent values of a normalised column."""
    return df.groupBy(F.lower(F.trim(column)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def outcome_rates(log: DataFrame, reasons: DataFrame) -> DataFrame:
    """Every known reason (0 where it never came up) with its count, its rate over all calls, and whether none was seen."""
    counts = log.groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = log.agg(F.count(F.lit(1)).alias("total"))
    rows = reasons.join(counts, "reason", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return rows.select("reason", n.alias("n"), F.when(F.col("total") == 0, 0.0).otherwise(F.round(n / F.col("total"), 6)).alias("rate"), (n == 0).alias("never"))


def latency_summary(log: DataFrame, stage: str, value: str) -> DataFrame:
    """Calls, mean, median, 95th percentile and greatest value by stage; the quantiles are exact, without a stage's values in one task."""
    rows = log.select(F.col(stage).alias("stage"), F.col(value).alias("value"))
    stats = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("greatest"))
    found = exact_quantiles(rows, ["stage"], "value", {"median": 0.5, "p95": 0.95})
    both = stats.alias("s").join(found.alias("q"), F.col("s.stage").eqNullSafe(F.col("q.stage")), "left")
    return both.select("s.stage", "s.calls", "s.mean", F.round("q.median", 4).alias("median"), F.round("q.p95", 4).alias("p95"), "s.greatest")


def request_limit(df: DataFrame, question: str, default: int = 10) -> DataFrame:
    """Column requested_limit: 'top N', else the first number in 1 to 50, else the default."""
    q = F.lower(F.col(question))
    top = F.try_element_at(F.regexp_extract_all(q, F.lit(r"\btop\s+(\d{1,9})\b"), 1), F.lit(1)).cast("int")
    numbers = F.filter(F.transform(F.regexp_extract_all(q, F.lit(r"\b(\d{1,9})\b"), 1), lambda x: x.cast("int")), lambda x: x.between(1, 50))
    return df.withColumn("requested_limit", F.least(F.lit(50), F.greatest(F.lit(1), F.coalesce(top, F.try_element_at(numbers, F.lit(1)), F.lit(default)))))
