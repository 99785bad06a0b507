"""Resolution of names to authors and institutions, a table of names at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import normalize_text
from lodestone.operators.spread import spread_join
from lodestone.sources.shared import written

#: Letters of the pieces by which names are indexed; no shorter name is asked.
GRAM = 3
#: Pieces in which the matches of a name are ranked before the first of each are ranked together.
PIECES = 64


def grams(name: Column) -> Column:
    """The distinct pieces of GRAM letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (GRAM - 1), F.lit(1))), lambda i: F.substring(name, i, F.lit(GRAM))))


def containing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(low, entity_low): the names of known (entity_low) that contain a name of asked (low, GRAM letters or more), distinct.

    Names are indexed by their pieces. A name that contains another has all its pieces, so each asked name is
    looked up by its rarest piece alone, and those found are compared in full. An asked name with a piece that no name has
    is not looked up. Common pieces are dealt over many tasks. Pieces that no asked name has are not indexed.
    """
    names = written(asked.select("low").distinct().select("low", F.explode(grams(F.col("low"))).alias("gram")), "asked-grams")
    index = known.select("entity_low").filter(F.length("entity_low") >= GRAM).distinct().select(F.explode(grams(F.col("entity_low"))).alias("gram"), "entity_low")
    index = written(index.join(names.select("gram").distinct(), "gram", "left_semi"), "gram-index")
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    weighed = names.join(frequency, "gram", "left").groupBy("low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unknown"))
    rarest = written(weighed.filter("unknown = 0").select("low", "gram"), "rarest")
    return spread_join(index, rarest, ["gram"]).filter(F.contains("entity_low", F.col("low"))).select("low", "entity_low")


def _matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, entity_id, exact) for distinct names of three letters or more: exact matches by an equality join, or containments for names without one."""
    asked = asked.select("name", F.lower("name").alias("low"), normalize_text(F.col("name")).alias("norm"))
    known = known.select("entity_id", F.lower("entity_name").alias("entity_low"), normalize_text(F.col("entity_name_normalized")).alias("entity_norm"))
    forms = known.select("entity_id", F.explode(F.array_distinct(F.array("entity_low", "entity_norm"))).alias("form"))
    wanted = asked.select("name", F.explode(F.array_distinct(F.array("low", "norm"))).alias("form"))
    exact = wanted.join(forms, "form").select("name", "entity_id").distinct()
    rest = written(asked.join(exact, "name", "left_anti").select("name", "low"), "open-names")
    found = containing(rest, known).join(known.select("entity_id", "entity_low"), "entity_low")
    contained = found.join(rest, "low").select("name", "entity_id")
    return exact.withColumn("exact", F.lit(True)).unionByName(contained.withColumn("exact", F.lit(False)))


def _shown(rows: DataFrame, most: int = 5) -> DataFrame:
    """Per name: number of matches, the best one, and the first `most` as candidates. A name's matches are cut to the first ones piece by piece, then over its pieces."""
    order = [F.desc("publications"), "entity_name", "entity_id"]
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.bool_or("exact").alias("exact"))
    pieces = Window.partitionBy("name", F.pmod(F.xxhash64("entity_id"), F.lit(PIECES))).orderBy(*order)
    first = rows.withColumn("r", F.row_number().over(pieces)).filter(F.col("r") <= most).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter(F.col("r") <= most)
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("r", "entity_id", "entity_name", "publications"))).alias("top"))
    return counts.join(listed, "name").select("name", "matches", "exact", F.col("top")[0]["entity_id"].alias("best"), F.transform("top", lambda s: F.concat_ws("|", s["entity_id"], s["entity_name"], s["publications"].cast("string"))).alias("candidates"))


def _found(names: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """The matches of each distinct name; how often a name is asked makes no more of them. Only matched entities' publications are counted; links may repeat."""
    asked = names.filter(F.length(F.trim("name")) >= 3).select("name").distinct()
    matches = written(_matches(asked, entities), "matches")
    links = links.join(matches.select("entity_id").distinct(), "entity_id", "left_semi")
    counts = links.groupBy("entity_id").agg(F.countDistinct("publication_id").alias("publications"))
    counted = entities.join(counts, "entity_id", "left").select("entity_id", "entity_name", F.coalesce("publications", F.lit(0)).alias("publications"))
    return _shown(written(spread_join(matches, counted, ["entity_id"]), "name-matches"))


def _status(names: DataFrame, found: DataFrame, narrowed: Column) -> DataFrame:
    n = F.coalesce("matches", F.lit(0))
    status = F.when(F.length(F.trim("name")) < 3, "skipped").when(n == 0, "not_found").when((n == 1) | narrowed, "resolved").otherwise("needs_clarification")
    rows = names.select("ask_id", "name").join(found, "name", "left").withColumn("status", status)
    return rows.select("ask_id", "status", n.alias("matches"), F.when(F.col("status") == "resolved", F.col("best")).alias("entity_id"), F.when(n > 1, F.col("candidates")).alias("candidates"), ((n > 1) & (F.col("status") == "resolved")).alias("narrowed"))


def resolve_authors(names: DataFrame, authors: DataFrame, pub_author: DataFrame) -> DataFrame:
    """One row for each (ask_id, name): resolved for one match, needs_clarification for more, not_found, or skipped (under three letters)."""
    entities = authors.select(F.col("author_id").alias("entity_id"), F.col("author_name").alias("entity_name"), F.col("author_name_normalized").alias("entity_name_normalized"))
    links = pub_author.select(F.col("author_id").alias("entity_id"), "publication_id")
    return _status(names, _found(names, entities, links), F.lit(False))


def resolve_institutions(names: DataFrame, institutions: DataFrame, pub_institution: DataFrame) -> DataFrame:
    """As for authors, but several matches are narrowed to the one with most publications (then the least name)."""
    entities = institutions.select(F.col("institution_id").alias("entity_id"), F.col("institution_name").alias("entity_name"), F.col("institution_name_normalized").alias("entity_name_normalized"))
    links = pub_institution.select(F.col("institution_id").alias("entity_id"), "publication_id")
    return _status(names, _found(names, entities, links), F.lit(True))
