"""Topics by seed terms, their evolution over years, expertise of authors, co-words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import icontains
from lodestone.operators.centroids import centroids
from lodestone.operators.graph import PAIR_BLOCK, counted_pairs, group_sizes
from lodestone.operators.keys import add_surrogate_key
from lodestone.sources.corpus import Corpus
from lodestone.sources.shared import tasks_for, written

#: Topic terms that are sent to every task; a larger table is refused rather than broadcast.
TERMS_MOST = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, of topics or their terms, when it is small enough to be sent to every task."""
    if df.limit(TERMS_MOST + 1).count() > TERMS_MOST:
        raise ValueError("too many topics or terms to send to every task")
    return df


def assign_topics(publications: DataFrame, keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """(topic_id, publication_id), distinct: a term of the topic is part of the lower-case title or of a keyword.

    Distinct titles and keywords are matched once, whatever the number of publications that carry them. Texts are made
    once, and repeats fall out with the topics, whose rows are shorter and fewer.
    """
    return assign_texts(texts_of(publications, keywords), terms)


def texts_of(publications: DataFrame, keywords: DataFrame) -> DataFrame:
    """(publication_id, text, is_keyword), written: lower-case titles and keywords, with repeats."""
    titles = publications.select("publication_id", F.lower("title").alias("text"), F.lit(False).alias("is_keyword"))
    texts = titles.unionByName(keywords.select("publication_id", F.lower("keyword").alias("text"), F.lit(True).alias("is_keyword"))).filter("text is not null")
    return written(texts, "texts")


def assign_texts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """assign_topics of texts_of."""
    small = F.broadcast(few(terms).select("topic_id", F.lower("term").alias("term")))
    matched = texts.select("text").distinct().join(small, F.contains(F.col("text"), F.col("term"))).select("topic_id", "text").distinct()
    matched = written(matched, "matched")
    # Few distinct texts (keywords) stand for very many rows; they are sent to every task while their number is checked.
    of_text = matched.groupBy("text").agg(F.collect_list("topic_id").alias("found"))
    if matched.limit(TERMS_MOST + 1).count() <= TERMS_MOST:
        of_text = F.broadcast(of_text)
    # Lists of a publication's topics, a row for each where its texts stand together; joins by publication find them in place.
    listed = texts.join(of_text, "text").groupBy("publication_id").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("topics"))
    return listed.select(F.explode("topics").alias("topic_id"), "publication_id")


def topic_totals(publications: DataFrame, assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """Publications, citations, first and latest year of every topic."""
    rows = assigned.join(publications.select("publication_id", "year", F.coalesce("citation_count", F.lit(0)).alias("cited")), "publication_id")
    sums = rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("total_publications"), F.sum("cited").alias("total_citations"), F.min("year").alias("first_year"), F.max("year").alias("latest_year"))
    return topics.join(sums, "topic_id", "left").select("topic_id", "topic_name", F.coalesce("total_publications", F.lit(0)).alias("total_publications"), F.coalesce("total_citations", F.lit(0)).alias("total_citations"), "first_year", "latest_year")


def topic_years(publications: DataFrame, assigned: DataFrame, topics: DataFrame, low: int, high: int) -> DataFrame:
    """Publications and citations of every topic in every year of the range, 0 where there are none."""
    grid = topics.select("topic_id").withColumn("year", F.explode(F.sequence(F.lit(low), F.lit(high))))
    rows = assigned.join(publications.select("publication_id", "year", F.coalesce("citation_count", F.lit(0)).alias("cited")), "publication_id")
    sums = rows.groupBy("topic_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("cited").alias("c"))
    return grid.join(sums, ["topic_id", "year"], "left").select("topic_id", "year", F.coalesce("n", F.lit(0)).alias("publication_count"), F.coalesce("c", F.lit(0)).alias("citation_count"))


def evolution(years: DataFrame, low: int, span: int = 5, formula: str = "growth", min_pubs: int = 1) -> DataFrame:
    """Growth, acceleration, recency weight and emerging flag of each topic and year.

    formula 'growth': (n - previous) / previous, 0.25 for a start from 0; acceleration is the change of growth.
    'documented': (n - previous) / max(1, previous); acceleration is the second difference of citations.
    """
    w = Window.partitionBy("topic_id").orderBy("year")
    n, before = F.col("publication_count"), F.lag("publication_count", 1, 0).over(w)
    if formula == "documented":
        growth = (n - before) / F.greatest(F.lit(1), before)
        second = F.col("citation_count") - 2 * F.lag("citation_count", 1, 0).over(w) + F.lag("citation_count", 2, 0).over(w)
        rows = years.withColumn("g", growth.cast("double")).withColumn("a", second.cast("double"))
    else:
        growth = F.when(before > 0, (n - before) / before).otherwise(F.when(n > 0, 0.25).otherwise(0.0))
        rows = years.withColumn("g", growth)
        rows = rows.withColumn("a", F.col("g") - F.lag("g", 1, 0.0).over(w))
    recency = F.least(F.lit(1.0), 0.5 + 0.5 * (F.col("year") - low) / span)
    return rows.select("topic_id", "year", "publication_count", "citation_count", F.round("g", 4).alias("growth_score"), F.round("a", 4).alias("citation_acceleration"), F.round(recency, 3).alias("recency_weight"), ((F.col("g") >= 0.20) & (n >= min_pubs)).alias("is_emerging"))


def cluster_keywords(assigned: DataFrame, keywords: DataFrame, n: int = 5) -> DataFrame:
    """(topic_id, keyword, publications, weight, rank): the n keywords that set each topic apart from the others.

    Class-based weighting: a keyword's share of the topic's keyword occurrences (one for each publication that carries it), times
    ln(1 + A / f), with f its occurrences in all topics and A the mean number of a topic's. Ties by keyword.
    """
    carried = keywords.select("publication_id", F.lower("keyword").alias("keyword"))
    names = written(carried.select("keyword").distinct(), "keyword-names")
    if names.limit(TERMS_MOST + 1).count() > TERMS_MOST:
        counts = assigned.join(carried.distinct(), "publication_id").groupBy("topic_id", "keyword").agg(F.count(F.lit(1)).alias("publications"))
    else:
        # Few keywords stand for very many rows: a publication's go through the shuffle as a list of their numbers.
        names = F.broadcast(written(add_surrogate_key(names, ["keyword"], "id").select(F.col("id").cast("int").alias("id"), F.col("keyword").alias("name")), "keyword-names"))
        lists = carried.join(names, F.col("keyword").eqNullSafe(F.col("name"))).groupBy("publication_id").agg(F.collect_set("id").alias("ids"))
        topics = assigned.groupBy("publication_id").agg(F.collect_set("topic_id").alias("topics"))
        met = topics.join(lists, "publication_id").select(F.explode("topics").alias("topic_id"), "ids").select("topic_id", F.explode("ids").alias("id"))
        counts = met.groupBy("topic_id", "id").agg(F.count(F.lit(1)).alias("publications")).join(names, "id").select("topic_id", F.col("name").alias("keyword"), "publications")
    counts = written(counts, "topic-keywords")
    own = counts.groupBy("topic_id").agg(F.sum("publications").alias("own"))
    every = counts.groupBy("keyword").agg(F.sum("publications").alias("every"))
    mean = own.agg((F.sum("own") / F.count(F.lit(1))).alias("mean"))
    weight = F.round(F.col("publications") / F.col("own") * F.log1p(F.col("mean") / F.col("every")), 9)
    rows = counts.join(own, "topic_id").join(every, "keyword").crossJoin(F.broadcast(mean)).select("topic_id", "keyword", "publications", weight.alias("weight"))
    w = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "keyword")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def topics_table(publications: DataFrame, keywords: DataFrame, chunks: DataFrame, assigned: DataFrame, topics: DataFrame, n: int = 5) -> DataFrame:
    """One row for each topic: its totals and years, cluster keywords in order, and the centroid of its publications' chunk vectors (null without any)."""
    assigned = written(assigned, "assigned")
    words = cluster_keywords(assigned, keywords, n)
    listed = words.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("cluster_keywords"))
    vectors = chunks.select(F.col("publication_id").cast("string").alias("publication_id"), "embedding").join(assigned, "publication_id")
    centres = centroids(vectors, "topic_id").select(F.col("grp").alias("topic_id"), "centroid")
    none = F.array().cast("array<string>")
    return topic_totals(publications, assigned, topics).join(listed, "topic_id", "left").join(centres, "topic_id", "left").withColumn("cluster_keywords", F.coalesce("cluster_keywords", none))


def h_index(df: DataFrame, group: list[str], citations: str) -> DataFrame:
    """h-index of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc(citations))
    return df.withColumn("_r", F.row_number().over(w)).groupBy(*group).agg(F.count_if(F.col(citations) >= F.col("_r")).alias("h_index"))


def coauthors(assigned: DataFrame, pub_author: DataFrame) -> DataFrame:
    """(author_id, topic_id, network): distinct other authors of the author's publications in the topic.

    A pair of authors goes through the shuffle once for each publication, with the list of its topics, not once for each topic and direction.
    """
    listed = assigned.groupBy("publication_id").agg(F.array_sort(F.collect_set("topic_id")).alias("topics"))
    pairs, tasks = counted_pairs(pub_author, "publication_id", "author_id")
    pairs = pairs.withColumnRenamed("g", "publication_id").join(listed, "publication_id").select("node_a", "node_b", "topics")
    # A pair seldom meets itself before the shuffle: it goes there as a plain row, to as many tasks as pairs need.
    known = pairs.repartition(tasks, "node_a", "node_b").groupBy("node_a", "node_b").agg(F.array_distinct(F.flatten(F.collect_set("topics"))).alias("topics"))
    ends = known.select(F.explode(F.array("node_a", "node_b")).alias("author_id"), "topics")
    return ends.select("author_id", F.explode("topics").alias("topic_id")).groupBy("author_id", "topic_id").agg(F.count(F.lit(1)).alias("network"))


def author_topics(c: Corpus, assigned: DataFrame, recent_from: int) -> DataFrame:
    """Each (author, topic) with at least one publication in the topic: matched, citations, recent, h_index, years, and the author's portfolio.

    Publications take their topics as a list, and their authors' rows go through the shuffle twice: to the publication and to the author.
    """
    listed = assigned.groupBy("publication_id").agg(F.collect_set("topic_id").alias("topics"))
    pubs = c.dated.select("publication_id", "year", F.coalesce("citation_count", F.lit(0)).alias("cited")).join(listed, "publication_id")
    own = c.author_lines.repartition("publication_id").distinct()  # repeats lie together
    every = own.join(pubs, "publication_id", "left").select("author_id", "year", "cited", "topics")
    every = every.withColumn("portfolio", F.count(F.lit(1)).over(Window.partitionBy("author_id")))
    rows = every.select("author_id", F.explode("topics").alias("topic_id"), "year", "cited", "portfolio")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("author_id", "topic_id").orderBy(F.desc("cited"))))
    recent = F.count_if(F.coalesce(F.col("year") >= recent_from, F.lit(False))).alias("recent")
    return rows.groupBy("author_id", "topic_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("cited").alias("citations"), recent, F.count_if(F.col("cited") >= F.col("_r")).alias("h_index"), F.max("portfolio").alias("portfolio"), F.collect_set("year").alias("years"))


def expertise(c: Corpus, assigned: DataFrame, recent_from: int, names: DataFrame | None = None) -> DataFrame:
    """Scores of each (author, topic) with at least one publication in the topic. names: a table with every topic_id of assigned, where there is one.

    Weights: relevance .30, productivity .25, impact .25, recency .20, each within 0 to 100.
    """
    rows = c.author_lines.select(F.col("publication_id").alias("g"), F.col("author_id").alias("i"))
    size = group_sizes(rows.filter("g is not null and i is not null"))
    ids = sorted(r[0] for r in (assigned if names is None else names).select("topic_id").distinct().limit(BITS + 1).collect())
    if (size.most or 0) <= PAIR_BLOCK and len(ids) <= BITS:
        found = networked(c, assigned, recent_from, tasks_for(c.spark, 4 * (size.pairs or 0)), bool(size.plain), ids)
    else:
        network = coauthors(assigned, c.pub_author.select("author_id", "publication_id"))
        found = author_topics(c, assigned, recent_from).join(network, ["author_id", "topic_id"], "left")
    return scored(found, F.coalesce("network", F.lit(0)).alias("coauthor_network_size"))


#: Topics that are held as the bits of one number.
BITS = 62


def networked(c: Corpus, assigned: DataFrame, recent_from: int, tasks: int, numbers: bool, ids: list[int]) -> DataFrame:
    """author_topics without years, and network, the author's coauthors in the topic, where no publication has many authors.

    An author's publications go through the shuffle once, each with its topics (bits, by their place in ids) and the list of its
    authors. All that is counted is counted where the author's rows lie: lists are taken apart there, and no pair is shuffled.
    numbers: names stand for numbers.
    """
    author = F.col("author_id").cast("bigint") if numbers else F.col("author_id")
    kind = "bigint" if numbers else dict(c.author_lines.dtypes)["author_id"]
    bit = F.coalesce(*(F.when(F.col("topic_id") == t, F.lit(1 << i).cast("long")) for i, t in enumerate(ids)), F.lit(0).cast("long"))
    listed = assigned.groupBy("publication_id").agg(F.bit_or(bit).alias("bits"))
    pubs = c.dated.select("publication_id", "year", F.coalesce("citation_count", F.lit(0)).alias("cited")).join(listed, "publication_id")
    own = c.author_lines.select("publication_id", author.alias("author_id")).repartition("publication_id").groupBy("publication_id").agg(F.collect_set("author_id").alias("all"))
    every = own.join(pubs, "publication_id", "left").select(F.explode("all").alias("author_id"), "all", "year", "cited", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    others = F.when(F.col("bits") != 0, F.array_remove("all", F.col("author_id")))
    recent = F.coalesce(F.col("year") >= recent_from, F.lit(False))
    dealt = every.select("author_id", others.alias("others"), recent.alias("recent"), "cited", "bits").repartition(tasks, "author_id")
    # A row for each publication, and one for each coauthor with the topics of all publications that are shared.
    no_one = F.array(F.lit(None).cast(kind))
    each = dealt.select("author_id", "recent", "cited", "bits", F.explode(F.concat(F.coalesce("others", F.array().cast(f"array<{kind}>")), no_one)).alias("other"))
    alone = F.col("other").isNull()
    own_bits, own_cited, own_recent = (F.when(alone, F.col(x)).alias(f"own_{x}") for x in ("bits", "cited", "recent"))
    counts = each.groupBy("author_id", "other", own_bits, own_cited, own_recent).agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("bits"))
    # Rows of publications count once more without a topic, for the portfolio.
    topic = dict(assigned.dtypes)["topic_id"]
    held = F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(t).cast(topic)) for i, t in enumerate(ids)), F.lit(None).cast(topic)), lambda t: t.isNotNull())
    rows = counts.select("author_id", "other", "own_cited", "own_recent", "n", F.explode(F.when(alone, F.concat(held, F.array(F.lit(None).cast(topic)))).otherwise(held)).alias("topic_id"))
    cited = F.when(F.col("topic_id").isNotNull(), F.col("own_cited")).alias("cited")
    counts = rows.groupBy("author_id", "topic_id", cited).agg(F.count("other").alias("network"), F.sum(F.when(alone, F.col("n"))).alias("n"), F.sum(F.when(alone & F.col("own_recent"), F.col("n"))).alias("recent"))
    found = counts.groupBy("author_id", "topic_id").agg(
        F.sum("n").alias("matched"), F.sum(F.col("cited") * F.col("n")).alias("citations"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent"), F.sum("network").alias("network"),
        F.sort_array(F.collect_list(F.when(F.col("cited").isNotNull(), F.struct("cited", "n"))), asc=False).alias("steps"),
    )
    # The h-index is the greatest of min(v, publications cited v times or more) over the citations v that there are.
    step = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.greatest(s["h"], F.least(x["cited"].cast("long"), s["n"] + x["n"])).alias("h"))
    h = F.aggregate("steps", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h")), step)["h"]
    portfolio = F.max(F.when(F.col("topic_id").isNull(), F.col("matched"))).over(Window.partitionBy("author_id"))
    found = found.withColumns({"portfolio": portfolio, "h_index": h}).filter("topic_id is not null")
    return found.select(F.col("author_id").cast("string").alias("author_id") if numbers else "author_id", "topic_id", "matched", "citations", "recent", "h_index", "portfolio", "network")


def scored(r: DataFrame, also: Column | str = "years") -> DataFrame:
    """The scores of author_topics, and one more column: the years in which there are publications of the author in the topic."""
    relevance = F.least(F.lit(100.0), F.greatest(F.lit(20.0), F.col("matched") / F.col("portfolio") * 100))
    productivity = F.least(F.lit(100.0), F.log1p("matched") / F.log1p(F.lit(10.0)) * 100)
    impact = F.least(F.lit(100.0), F.log1p("citations") / F.log1p(F.lit(50.0)) * 80 + F.least(F.lit(20.0), F.col("h_index") * 5.0))
    recency = F.least(F.lit(100.0), F.col("recent") / F.col("matched") * 100)
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.30 * relevance + 0.25 * productivity + 0.25 * impact + 0.20 * recency))
    return r.select("author_id", "topic_id", F.round(total, 4).alias("expertise_score"), F.round(relevance, 4).alias("relevance_score"), F.round(productivity, 4).alias("productivity_score"), F.round(impact, 4).alias("impact_score"), F.round(recency, 4).alias("recency_score"), F.col("h_index").alias("h_index_topic"), F.col("matched").alias("publication_count_topic"), F.col("citations").alias("citation_count_topic"), also)


def trends(evolved: DataFrame, topics: DataFrame, topic_id: int | None = None, emerging_only: bool = False, low: int | None = None, high: int | None = None, n: int = 10) -> DataFrame:
    """Topic years, newest and fastest growing first."""
    rows = evolved.join(topics.select("topic_id", "topic_name"), "topic_id")
    for given, test in ((topic_id, F.col("topic_id") == topic_id), (emerging_only or None, F.col("is_emerging")), (low, F.col("year") >= low), (high, F.col("year") <= high)):
        if given is not None:
            rows = rows.filter(test)
    return rows.orderBy(F.desc("year"), F.desc("growth_score"), "topic_id").limit(n)


def experts(scores: DataFrame, authors: DataFrame, topic_id: int | None = None, author_id: str | None = None, n: int = 10) -> DataFrame:
    rows = scores if topic_id is None else scores.filter(F.col("topic_id") == topic_id)
    rows = rows if author_id is None else rows.filter(F.col("author_id") == author_id)
    return rows.join(authors.select("author_id", "author_name"), "author_id").orderBy(F.desc("expertise_score"), "author_id", "topic_id").limit(n)


def expert_publications(c: Corpus, scores: DataFrame, assigned: DataFrame, n: int = 50) -> DataFrame:
    """Publications behind experts, in their topic: distinct, newest first."""
    rows = scores.select("author_id", "topic_id").join(assigned, "topic_id").join(c.pub_author.select("author_id", "publication_id"), ["author_id", "publication_id"])
    return rows.select("publication_id").distinct().join(c.publications.select("publication_id", "title", "year"), "publication_id").orderBy(F.desc_nulls_last("year"), "publication_id").limit(n)


def resolve_topics(names: DataFrame, totals: DataFrame) -> DataFrame:
    """The largest topic whose name contains the asked name; else null with ten candidates. names: ask_id, name."""
    topics = F.broadcast(few(totals).select("topic_id", "topic_name", "total_publications"))
    hits = names.join(topics, icontains(F.col("topic_name"), F.col("name")))
    best = hits.groupBy("ask_id").agg(F.max_by("topic_id", F.struct("total_publications", -F.col("topic_id"))).alias("topic_id"))
    first = totals.orderBy(F.desc("total_publications"), "topic_name").limit(10).select(F.struct((-F.col("total_publications")).alias("n"), "topic_name").alias("s"))
    listed = first.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["topic_name"]).alias("listed"))
    return names.join(best, "ask_id", "left").crossJoin(F.broadcast(listed)).select("ask_id", "topic_id", F.when(F.col("topic_id").isNull(), F.col("listed")).alias("candidates"))


def cluster_chunks(chunks: DataFrame, keywords: DataFrame, k: int, words: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Clusters of chunk embeddings by k-means, and the most frequent keywords of each cluster's publications."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "publication_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed).fit(v).transform(v).select("chunk_id", "publication_id", F.col("prediction").alias("cluster"))
    counted = found.select("cluster", "publication_id").distinct().join(keywords.select(F.col("publication_id"), "keyword").distinct(), "publication_id").groupBy("cluster", "keyword").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "keyword")
    return found, counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= words)
