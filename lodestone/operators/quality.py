"""Data-quality gates, backfills, surrogate keys, cleaning and merging of duplicate records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.columns import normalize_text
from lodestone.operators.graph import components


def schema_audit(df: DataFrame, expected: StructType, table: str) -> DataFrame:
    """(table, column, level, note): missing columns are errors, other types warnings, more columns notes."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in expected}
    rows = [(table, c, "error", "missing") for c in wanted if c not in actual]
    rows += [(table, c, "warning", f"{actual[c]} instead of {t}") for c, t in wanted.items() if c in actual and actual[c] != t]
    rows += [(table, c, "note", "unexpected") for c in actual if c not in wanted]
    return df.sparkSession.createDataFrame(rows, "table string, column string, level string, note string")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null in part or occur more than once, with their rows."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | null)


def range_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row that breaks a rule; a rule that is null for a row is not broken."""
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges out of order, without provenance, with another weight than provenance, or with an unknown end."""
    rules = {"order": F.col("node_a") < F.col("node_b"), "provenance": F.size("via") > 0, "weight": F.col("weight") == F.size("via")}
    found = range_violations(edges.withColumn("key", F.concat_ws("-", "node_a", "node_b")), "key", rules)
    ends = edges.select(F.concat_ws("-", "node_a", "node_b").alias("key"), F.explode(F.array("node_a", "node_b")).alias("node"))
    return found.unionByName(ends.join(nodes.select("node").distinct(), "node", "left_anti").select(F.lit("unknown_end").alias("rule"), "key"))


def embedding_report(chunks: DataFrame, size: int) -> DataFrame:
    """One row: chunks, without vector, of another size, chunks a publication."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("without"), F.count_if(F.size("embedding") != size).alias("other_size"), F.round(F.count(F.lit(1)) / F.countDistinct("publication_id"), 4).alias("per_publication"))


def embedding_versions(stored: DataFrame) -> DataFrame:
    """Stored embeddings of each (model, version, dimension), and whether all have the same one; null stamps are a kind of their own."""
    kinds = stored.groupBy("embedding_model", "embedding_version", "embedding_dimension").agg(F.count(F.lit(1)).alias("chunks"))
    single = kinds.agg((F.count(F.lit(1)) <= 1).alias("single"))
    return kinds.crossJoin(F.broadcast(single))  # one row


def row_counts(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(table, rows, expected, ok) against least row counts."""
    each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(least[n]).cast("long").alias("expected")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, each).withColumn("ok", F.col("rows") >= F.col("expected"))


def fenced_columns(df: DataFrame, forbidden: list[str], table: str) -> DataFrame:
    """Columns whose name matches a forbidden pattern."""
    import re

    rows = [(table, f.name) for f in df.schema if any(re.search(p, f.name) for p in forbidden)]
    return df.sparkSession.createDataFrame(rows, "table string, column string")


def backfill_column(target: DataFrame, staging: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """target with the staged values of a column (a staged null overwrites), and a report of the staging."""
    s = staging.select(key, F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    joined = target.join(s, key, "left")
    out = joined.withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).drop("_value", "_hit").select(*target.columns)
    orphan = staging.join(target.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    updated = target.join(staging.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("updated"))
    filled = staging.agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count_if(F.trim(F.col(column).cast("string")) != "").alias("non_blank"))
    return out, updated.crossJoin(orphan).crossJoin(filled)


def backfill_accepted(report: DataFrame) -> DataFrame:
    return report.withColumn("accepted", (F.col("orphans") == 0) & (F.col("nulls") == 0) & (F.col("updated") == F.col("non_blank")))


ROLES = {"id": lambda c: c, "title": F.initcap, "narrative": F.lower, "normalized": lambda c: normalize_text(c)}


def clean(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns by role: ids as they are, titles in title case, narrative lower, normalized without punctuation."""
    return df.withColumns({c: ROLES[r](F.trim(F.col(c))) if r != "id" else F.col(c) for c, r in roles.items()})


def quarantine(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others with a reason."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"no {c}")) for c in required)), lambda x: x.isNotNull())
    marked = df.withColumn("reason", F.array_join(missing, ", "))
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def duplicate_groups(df: DataFrame, key: str, tiers: dict[str, Column]) -> DataFrame:
    """(key, group_key, tier): records joined by an equal non-null value in any tier, also over several steps.

    In each tier a record is linked to the least key with its value, so a value that many share makes as
    many links as records. tier is the first one that links the record to another.
    """
    key_of = F.col(key).cast("string")
    links = None
    for rank, (name, value) in enumerate(tiers.items()):
        each = df.select(key_of.alias("k"), value.alias("v")).filter("v is not null")
        heads = each.groupBy("v").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        tied = each.join(heads, "v").select("k", "head", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("tier")).alias("t"))
        links = tied if links is None else links.unionByName(tied)
    roots = components(links.select(F.col("k").alias("node_a"), F.col("head").alias("node_b")))
    first = links.groupBy("k").agg(F.min("t").alias("t"))
    return df.select(key_of.alias("k")).join(roots, F.col("k") == F.col("node"), "left").join(first, "k", "left").select(F.col("k").alias("key"), F.coalesce("root", "k").alias("group_key"), F.col("t.tier").alias("tier"))


def merge_duplicates(df: DataFrame, groups: DataFrame, key: str, columns: list[str], greatest: list[str]) -> DataFrame:
    """One record for each group: of every column the value of the fullest record that has one, and the greatest of some."""
    full = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    rows = df.withColumn("_key", F.col(key).cast("string")).join(groups.select(F.col("key").alias("_key"), "group_key"), "_key").withColumn("_full", full)
    order = F.struct(-F.col("_full"), F.col("_key"))
    picked = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("records"), *picked, *(F.max(c).alias(c) for c in greatest))
