"""The training-data pipeline: toxic documents go, then copies, near copies and benchmark passages; what stays is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import contamination, exact_dedup, jaccard_join, sentencepiece_scan, toxicity
from lodestone.llm.common import unused, written
from lodestone.llm.queries import held_out, table

#: Scores from here on are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC. Learns from the labels of the training fold, as the operator's query does."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    score = unused(docs, "toxicity_score")
    return toxicity.toxicity(docs, model, out=score).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat that doc_id and text, one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", "text_sha256")
    once = written(kept.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")), "kept")
    d, k = docs.alias("d"), once.alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.sha2(F.coalesce("d.text", F.lit("")), 256) == F.col("k.text_sha256"))
    stay = d.join(k, same, "left_semi")
    return stay if once.filter("rows > 1").isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 or more, the one with the least doc_id; others as they are."""
    kept = jaccard_join.jaccard_join(docs).filter("kept").select("doc_id")
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items."""
    found = unused(docs, "contamination")
    return contamination.contamination(docs, table(spark, sf_dir, "benchmark"), out=found).filter(~F.col(f"{found}.contaminated")).drop(found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the whole text, how many, and whether they decode to the same text."""
    both = sentencepiece_scan.encode(docs.select("doc_id", "text"), round_trip="round_trip")
    return both.select("doc_id", "ids", F.floor(F.octet_length("ids") / 4).alias("n_ids"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Trained scores, a MinHash forest and a tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
