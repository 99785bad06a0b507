"""Retrieval evaluation: metrics of each query, threshold sweeps, selection and regression gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ideal_of(relevance: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, relevant, idcg): the relevant publications of each query and the gain of the best order of them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "publication_id")
    ranked = relevance.withColumn("r", F.row_number().over(w))
    return ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1))).alias("idcg"))


def ideal_of_counts(counts: DataFrame, grades: list[int], k: int = 8) -> DataFrame:
    """ideal_of from how many publications have each grade, highest first (columns query_id, n_<grade>), without a row for each of them."""
    discounts = [0.0]
    for r in range(1, k + 1):
        discounts.append(discounts[-1] + 1 / math.log2(r + 1))
    upto = F.array(*map(F.lit, discounts))
    before, idcg = F.lit(0).cast("long"), F.lit(0.0)
    for g in grades:
        after = before + F.col(f"n_{g}")
        idcg = idcg + g * (F.get(upto, F.least(after, F.lit(k)).cast("int")) - F.get(upto, F.least(before, F.lit(k)).cast("int")))
        before = after
    return counts.select("query_id", before.alias("relevant"), idcg.alias("idcg"))


def _metrics(graded: DataFrame, every: DataFrame, ideal: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Metrics by keys, query_id among them: graded are the results shown (rank, and grade or null), every has all keys."""
    found = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("shown"), F.count("grade").alias("relevant_found"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first_rank"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = every.join(found, keys, "left").join(ideal, "query_id", "left")
    rows = rows.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("shown", "relevant_found", "relevant")), "first_rank", F.coalesce("dcg", F.lit(0.0)).alias("dcg"), F.coalesce("idcg", F.lit(0.0)).alias("idcg"))

    def share(a, b):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    return rows.select(
        *keys, "shown", "relevant",
        share(F.col("relevant_found"), F.lit(k)).alias("precision"),
        share(F.col("relevant_found"), F.col("relevant")).alias("recall"),
        share(F.least(F.col("relevant"), F.lit(k)), F.col("relevant")).alias("recall_ceiling"),
        (F.col("relevant_found") > 0).cast("int").alias("hit"),
        share(F.lit(1.0), F.col("first_rank")).alias("mrr"),
        share(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def query_metrics(hits: DataFrame, relevance: DataFrame, queries: DataFrame, k: int = 8, ideal: DataFrame | None = None) -> DataFrame:
    """Precision, recall, its ceiling, hit, MRR and nDCG at k of each query.

    hits: query_id, publication_id, rank. relevance: query_id, publication_id, grade (1 to 3), a pair once. nDCG gains are grades.
    With ideal (see ideal_of), relevance needs no other pairs than those of hits.
    """
    graded = hits.filter(F.col("rank") <= k).join(relevance.select("query_id", "publication_id", "grade"), ["query_id", "publication_id"], "left")
    return _metrics(graded, queries.select("query_id"), ideal_of(relevance, k) if ideal is None else ideal, ["query_id"], k)


def category_means(metrics: DataFrame, about: DataFrame) -> DataFrame:
    """Means of query_metrics by category, and one row over all (category null).

    about: query_id, category, has_answer, top_similarity. Quality is averaged over queries that have an answer; those that have none
    (negatives) tell false positives, which are queries with any result. A category without either kind has zeros for it.
    """
    rows = metrics.join(about, "query_id").select("*", F.when(F.col("has_answer"), 1).alias("positive"), F.when(~F.col("has_answer"), 1).alias("negative"))

    def over(kind: str, column: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(F.col(kind) == 1, F.col(column))), F.lit(0.0)), 4)

    means = [over("positive", c).alias(c) for c in ("ndcg", "precision", "recall", "recall_ceiling", "hit", "mrr")]
    means += [over("positive", "shown").alias("mean_shown"), over("positive", "top_similarity").alias("mean_top_similarity"), over("negative", "top_similarity").alias("mean_top_similarity_negative")]
    false = F.count(F.when((F.col("negative") == 1) & (F.col("shown") > 0), 1))
    counts = [F.count(F.lit(1)).alias("queries"), F.count("positive").alias("positives"), F.count("negative").alias("negatives"), false.alias("false_positives")]
    rate = F.round(F.coalesce(F.try_divide(false, F.count("negative")), F.lit(0.0)), 4).alias("false_positive_rate")
    shown = rows.groupingSets([["category"], []], "category").agg(*counts, *means, rate, F.grouping("category").alias("all"))
    return shown.withColumn("category", F.when(F.col("all") == 0, F.coalesce(F.col("category").cast("string"), F.lit("")))).drop("all")


def sweep(scored: DataFrame, relevance: DataFrame, queries: DataFrame, thresholds: list[float], k: int = 8, ideal: DataFrame | None = None) -> DataFrame:
    """Means over queries at each threshold, from one scoring with an open gate (scored: query_id, publication_id, similarity, rank).

    Results are graded once and then shown at each gate; what is relevant to a query is the same at all of them. ideal: see query_metrics.
    """
    gates = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    graded = scored.filter(F.col("rank") <= k).join(relevance.select("query_id", "publication_id", "grade"), ["query_id", "publication_id"], "left")
    shown = graded.withColumn("threshold", gates).filter(F.col("similarity") >= F.col("threshold"))
    every = queries.select("query_id").withColumn("threshold", gates)
    m = _metrics(shown, every, ideal_of(relevance, k) if ideal is None else ideal, ["threshold", "query_id"], k)
    return m.groupBy("threshold").agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "hit", "mrr", "ndcg")))


def false_positives(scored: DataFrame, negatives: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of negative queries with any result at each threshold, and the greatest similarity seen."""
    gates = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    best = negatives.select("query_id").join(scored.groupBy("query_id").agg(F.max("similarity").alias("top")), "query_id", "left").withColumn("threshold", gates)
    return best.groupBy("threshold").agg(F.count(F.lit(1)).alias("negatives"), F.round(F.avg((F.coalesce("top", F.lit(-1.0)) >= F.col("threshold")).cast("double")), 6).alias("false_positive_rate"), F.round(F.max("top"), 4).alias("greatest"))


def select_threshold(points: DataFrame, tie: float = 0.02) -> DataFrame:
    """The highest gate among those without false positives whose nDCG is within `tie` of the best; null if there is none.

    points: threshold, ndcg, false_positive_rate.
    """
    clean = points.filter(F.col("false_positive_rate") == 0)
    best = clean.agg(F.max("ndcg").alias("best"))
    return clean.crossJoin(F.broadcast(best)).agg(F.max(F.when(F.col("ndcg") >= F.col("best") - tie, F.col("threshold"))).alias("threshold"))


def regressions(actual: DataFrame, floors: DataFrame) -> DataFrame:
    """Metrics below their floor (both: metric, value)."""
    return actual.join(floors.withColumnRenamed("value", "floor"), "metric").filter(F.col("value") < F.col("floor"))


def validate_benchmark(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """(rule, query_id) of violations: blank text, repeated ids, negatives with a relevant grade, grades of unknown queries."""
    blank = queries.filter(F.coalesce(F.trim("query"), F.lit("")) == "").select(F.lit("blank_query").alias("rule"), "query_id")
    twice = queries.groupBy("query_id").count().filter("count > 1").select(F.lit("repeated_id").alias("rule"), "query_id")
    graded = relevance.filter("grade > 0").select("query_id").distinct()
    wrong = queries.filter("NOT has_answer").join(graded, "query_id", "left_semi").select(F.lit("negative_with_grade").alias("rule"), "query_id")
    unknown = relevance.select("query_id").distinct().join(queries, "query_id", "left_anti").select(F.lit("unknown_query").alias("rule"), "query_id")
    return blank.unionByName(twice).unionByName(wrong).unionByName(unknown)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact results that were found."""
    hit = exact.join(found.select("query_id", "publication_id"), ["query_id", "publication_id"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    return exact.agg(F.count(F.lit(1)).alias("all")).crossJoin(hit).select(F.round(F.coalesce(F.try_divide("hit", "all"), F.lit(1.0)), 6).alias("recall"))


def fingerprint(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One row that tells a table's rows apart from any other's: table, rows, and two sums of 60 bits of each row's MD5.

    The sums do not depend on the order or partitions of rows, and a repeated row counts again. They are partial in each task; null differs from
    any text. Columns are taken as strings; give vectors as rounded whole numbers.
    """
    parts = [F.when(F.col(c).isNull(), F.lit("\\N")).otherwise(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))) for c in columns]
    digest = F.md5(F.array_join(F.array(*parts), "\x1f"))
    lane = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), lane(1).alias("lane_a"), lane(17).alias("lane_b")).select(F.lit(table).alias("table"), "rows", "lane_a", "lane_b")


def fingerprint_changes(now: DataFrame, labelled: DataFrame) -> DataFrame:
    """(table, change) of tables that are not those a benchmark was labelled against: missing, new, other_rows (their number) or other_content."""
    a, b = now.alias("a"), labelled.alias("b")
    both = a.join(b, F.col("a.table") == F.col("b.table"), "full")
    other = (F.col("a.lane_a") != F.col("b.lane_a")) | (F.col("a.lane_b") != F.col("b.lane_b"))
    change = F.when(F.col("a.table").isNull(), "missing").when(F.col("b.table").isNull(), "new").when(F.col("a.rows") != F.col("b.rows"), "other_rows").when(other, "other_content")
    return both.select(F.coalesce("a.table", "b.table").alias("table"), change.alias("change")).filter("change is not null")
