"""Transcript analytics: session lists, windows, scope, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import clamped, ellipsis, scope_label, session_title, source_identity

# The filters that later turns inherit, in the order in which they are shown, and their labels. A bare year is not inherited.
SCOPE_KEYS = ["country", "author_name", "institution_name", "topic_name", "keyword", "document_type", "year_from", "year_to"]
SCOPE_LABELS = {"country": "Negara", "author_name": "Penulis", "institution_name": "Institusi", "topic_name": "Topik", "keyword": "Kata kunci", "document_type": "Tipe dokumen", "year_from": "Tahun mulai", "year_to": "Tahun akhir"}
# Headings of a prompt's parts, and who speaks.
SUMMARY_HEAD, SCOPE_HEAD, TURNS_HEAD = "[Ringkasan percakapan]", "[Cakupan sesi]", "[Percakapan sebelumnya]"
USER_SPEAKS, ASSISTANT_SPEAKS = "Pengguna", "Asisten (jawaban sebelumnya, BUKAN bukti)"


def sessions(messages: DataFrame, limit: int | None = None, about: DataFrame | None = None, status: str = "active") -> DataFrame:
    """Sessions by last activity: messages, distinct sources, last assistant route, title from the first question.

    A source is told by its publication, else its DOI, else its title (messages.sources, an array; none counts as no sources). With
    about (session_id, status) only sessions of that status are listed; those that it does not name are active.
    """
    user, answered = F.col("role") == "user", (F.col("role") == "assistant") & F.col("route").isNotNull()
    first = F.min_by(F.when(user, F.col("content")), F.when(user, F.col("seq")))
    route = F.max_by("route", F.when(answered, F.struct("created_at", "seq")))
    rows = messages.groupBy("session_id").agg(
        F.countDistinct("seq").alias("message_count"), F.countDistinct("route").alias("route_count"), route.alias("last_route"),
        F.max("created_at").alias("last_message_at"), session_title(first).alias("title"),
    )
    if about is not None:
        known = about.select(F.col("session_id").alias("known_id"), "status")
        rows = rows.join(known, F.col("session_id").eqNullSafe(F.col("known_id")), "left").filter(F.coalesce("status", F.lit("active")) == status).drop("known_id", "status")
    shown = rows.orderBy(F.desc_nulls_last("last_message_at"), "session_id").limit(clamped(limit, 20))
    return _with_source_count(shown, messages).orderBy(F.desc_nulls_last("last_message_at"), "session_id")


def _with_source_count(shown: DataFrame, messages: DataFrame) -> DataFrame:
    """The few sessions of a page with source_count; only their messages' sources are opened."""
    if "sources" not in messages.columns:
        return shown.withColumn("source_count", F.lit(0).cast("long"))
    page = F.broadcast(shown.select(F.col("session_id").alias("page_id")))  # LIMIT_MOST rows at most
    opened = messages.select("session_id", "sources").join(page, F.col("session_id").eqNullSafe(F.col("page_id")), "left_semi")
    each = opened.select(F.col("session_id").alias("counted_id"), F.explode("sources").alias("source"))
    n = each.groupBy("counted_id").agg(F.countDistinct(source_identity(F.col("source"))).alias("n"))
    joined = shown.join(n, F.col("session_id").eqNullSafe(F.col("counted_id")), "left")
    return joined.select(*shown.columns, F.coalesce("n", F.lit(0)).alias("source_count"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each session, numbered oldest first."""
    w = Window.partitionBy("session_id")
    last = messages.withColumn("_r", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("seq")))).filter(F.col("_r") <= n)
    return last.withColumn("position", F.row_number().over(w.orderBy("created_at", "seq"))).drop("_r")


def scope_keys(messages: DataFrame) -> list[str]:
    """The inherited filters that messages has, in their order."""
    return [k for k in SCOPE_KEYS if k in messages.columns]


def _given(messages: DataFrame, key: str) -> Column:
    """A filter as set by a turn; an empty text is not set."""
    return F.nullif(F.col(key), F.lit("")) if messages.schema[key].dataType.typeName() == "string" else F.col(key)


def scope(messages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each turn with the last set value of every key so far (scope_<key>)."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumns({f"scope_{k}": F.last(_given(messages, k), ignorenulls=True).over(w) for k in keys or scope_keys(messages)})


def effective_filters(scoped: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Explicit values win, scope fills the gaps; inherited names the filled keys, in their order."""
    keys = keys or scope_keys(scoped)
    own = {k: _given(scoped, k) for k in keys}
    filled = F.filter(F.array(*(F.when(own[k].isNull() & F.col(f"scope_{k}").isNotNull(), F.lit(k)) for k in keys)), lambda x: x.isNotNull())
    return scoped.withColumns({"inherited": filled, **{f"effective_{k}": F.coalesce(own[k], F.col(f"scope_{k}")) for k in keys}})


def last_scope(messages: DataFrame) -> DataFrame:
    """One row for each session: the last set value of every key (an aggregate: partial in each task), messages_covered."""
    keys = scope_keys(messages)
    latest = (F.max_by(_given(messages, k), F.when(_given(messages, k).isNotNull(), F.col("seq"))).alias(k) for k in keys)
    return messages.groupBy("session_id").agg(*latest, F.countDistinct("seq").alias("messages_covered"))


def summaries(messages: DataFrame, earlier: int = 6, most: int = 1200) -> DataFrame:
    """One row for each session: the latest question, scope, earlier questions newest first, cut to `most` characters; messages covered."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    asked = messages.filter("role = 'user'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= earlier + 1)
    lines = asked.groupBy("session_id").agg(F.max(F.when(F.col("r") == 1, ellipsis(F.col("content"), 200))).alias("latest"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", ellipsis(F.col("content"), 160).alias("q"))))), lambda s: s["q"]).alias("before"))
    last = last_scope(messages)
    rows = last.join(lines, "session_id", "left")
    label = scope_label(scope_keys(messages))
    text = F.concat_ws("\n", F.concat(F.lit("Latest: "), F.col("latest")), F.when(label != "", F.concat(F.lit("Scope: "), label)), F.when(F.size("before") > 0, F.concat(F.lit("Earlier: "), F.array_join("before", " | "))))
    return rows.select("session_id", F.substring(text, 1, most).alias("summary"), "messages_covered")


def block(messages: DataFrame, n: int = 6) -> DataFrame:
    """One text for each session: its newest turns, labelled, oldest first."""
    turn = F.struct("position", F.concat(F.initcap("role"), F.lit(": "), ellipsis(F.col("content"), 200)).alias("line"))
    return recent(messages, n).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda s: s["line"]), "\n").alias("block"))


def context(messages: DataFrame, stored: DataFrame | None = None, n: int = 6, most: int = 200) -> DataFrame:
    """One prompt text for each session: its stored summary (session_id, summary), its scope, and its newest n turns, oldest first.

    Parts that have nothing to say are left out; a turn is cut to `most` characters. Assistant turns are marked as no evidence.
    """
    speaker = F.when(F.col("role") == "user", USER_SPEAKS).otherwise(ASSISTANT_SPEAKS)
    turn = F.struct("position", F.concat(speaker, F.lit(": "), ellipsis(F.coalesce("content", F.lit("")), most)).alias("line"))
    turns = recent(messages, n).groupBy(F.col("session_id").alias("turns_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["line"]), "\n").alias("turns"))
    rows = last_scope(messages).join(turns, F.col("session_id").eqNullSafe(F.col("turns_id")), "left")
    summary = F.lit(None).cast("string")
    if stored is not None:
        kept = stored.select(F.col("session_id").alias("stored_id"), F.nullif(F.trim("summary"), F.lit("")).alias("summary"))
        rows, summary = rows.join(kept, F.col("session_id").eqNullSafe(F.col("stored_id")), "left"), F.col("summary")
    told = scope_label(scope_keys(messages), SCOPE_LABELS)
    parts = [(SUMMARY_HEAD, summary), (SCOPE_HEAD, F.nullif(told, F.lit(""))), (TURNS_HEAD, F.col("turns"))]
    return rows.select("session_id", F.concat_ws("\n\n", *(F.concat(F.lit(head + "\n"), text) for head, text in parts)).alias("context"))


def upsert_summaries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of the same session replaced."""
    return stored.join(fresh.select("session_id"), "session_id", "left_anti").unionByName(fresh)


def stale(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with more messages than their summary covers."""
    n = messages.groupBy("session_id").agg(F.countDistinct("seq").alias("messages"))
    return stored.select("session_id", "messages_covered").join(n, "session_id").filter("messages_covered < messages")
