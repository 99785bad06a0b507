"""Reading of a questions table: route, intent, years, limits, names; all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import ignored_filters
from lodestone.operators.relational import request_limit

# Words of questions in English and Indonesian.
PUBLICATIONS = "publications?|papers?|articles?|stud(?:y|ies)|publikasi|artikel|jurnal|karya"
AUTHORS = "authors?|researchers?|penulis|peneliti"
INSTITUTIONS = "institutions?|universit(?:y|ies)|affiliations?|institusi|universitas"
GRANTS = "funding|funded|grants?|dana|hibah"
MEAN = r"average|mean|rata-?\s?rata|rerata"
BEST = "teratas|terproduktif|paling produktif"
NUMBER = "berapa(?:kah)?|jumlah|total|hitung"
TOPIC_AREAS = "topics?|topik|bidang|research areas?|clusters?"
# Intents in the order in which they are tried, with what tells them.
INTENTS = [
    ("average_citations", rf"\b(?:{MEAN})\b.*\b(?:citation|sitasi)"),
    ("most_cited", r"\b(?:most|top|highest)[ -]cit(?:ed|ations?)\b|\bpaling banyak disitasi\b|\bsitasi terbanyak\b"),
    ("funding", rf"\b(?:{GRANTS})\b"),
    ("top_institutions", rf"\b(?:top|most productive)\b.*\b(?:{INSTITUTIONS})\b|\b(?:{INSTITUTIONS})\s+(?:{BEST}|top)\b"),
    ("top_authors", rf"\b(?:top|most productive|most prolific|most active)\b.*\b(?:{AUTHORS})\b|\b(?:{AUTHORS})\s+(?:{BEST})\b|\b(?:highest|most|greatest)\s+(?:publication count|publications|papers|articles)\b"),
    ("count", rf"\b(?:how many|number of|count)\b|\b(?:{NUMBER})\b.*\b(?:{PUBLICATIONS})\b|\bseberapa banyak\b"),
    ("list", rf"\b(?:list|show|which|daftar|tampilkan|sebutkan)\b.*\b(?:{PUBLICATIONS})\b|\b(?:{PUBLICATIONS})\s+(?:pada tahun|tahun|in year|published in|(?:in|on)\s+\d{{4}})"),
]
# Routes in the order in which they are tried. A question that an intent reads goes to the tables, so that no intent is out of reach.
ROUTES = [
    ("graph", r"\b(?:collaborat|co-?author|partner|network|path between|connected|worked with|joint publication|published with|kolaborasi|berkolaborasi|kerja ?sama|kemitraan|rekan penulis|jaringan|mitra)|\b(?:bekerja|kerja)\s+(?:bersama|dengan|pada)\b"),
    ("hybrid", rf"\b(?:tren|emerging|expert|growing|growth score|hotspot|evolution|evolved|perkembangan|evolusi|kepakaran|policy synthesis|sintesis kebijakan|rekomendasi kebijakan|arah riset)|\b(?:pakar|ahli)\b|\b(?:berkembang|baru|terbaru|muncul)\b.*\b(?:{TOPIC_AREAS})\b|\b(?:{TOPIC_AREAS})\s+(?:berkembang|baru|populer)\b|\btop\s*\d*\s*(?:{TOPIC_AREAS})\b"),
    ("sql", r"\b(?:top \d+|\d+ teratas|peringkat|ranking|total|list|funding agency|sumber dana|grant number|open access|document type|tipe dokumen|bahasa dokumen)\b|" + "|".join(p for _, p in INTENTS)),
    ("vector", r"\b(?:about|similar|related to|discuss|explain|what is|(?:papers?|articles?|studies|literature) on|(?:concept|mechanism|role|effect|impact) of|tentang|mengenai|membahas|meneliti|konsep|mekanisme|pengaruh|efek|peran|terkait)"),
]
# Words with which a topic filter asks for trends, and words with which other filters ask for rows of tables.
TREND_WORDS = r"tren|pakar|expert|evolusi|growth"
LISTING_WORDS = r"siapa|who|berapa|how many|daftar|list|tampilkan|show|publikasi|papers"
ROW_FILTERS = ["year", "year_from", "year_to", "author_name", "institution_name", "country", "document_type", "keyword"]
# What a topic's words come after, and what they end before.
TOPIC_AFTER = r"topik|bidang|riset|terapi|teknologi|domain|tentang|mengenai|on|about|evolution of"
TOPIC_BEFORE = r"5\s*tahun|dalam|pada|tahun|di|in|who|siapa|dan|and|setelah|sejak|sebelum|antara|after|since|before|between|from|over time|evolusi|evolv\w*|berkembang\w*"
YEAR_LOW, YEAR_HIGH = 1900, 2026
USED = {"sql": {"year", "author_name", "institution_name", "country"}, "vector": {"year", "country", "author_name", "document_type"}, "graph": {"author_name", "institution_name", "keyword"}, "hybrid": {"topic_name", "year", "author_name"}}


def first_match(question: Column, rules: list[tuple[str, str]], other: str | None) -> Column:
    """The name of the first rule that the question matches."""
    out = F.lit(other).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.lower(question).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _set(df: DataFrame, filters: list[str]) -> Column:
    """Whether a row has any of the filters that df has; an empty text is none."""
    some = F.lit(False)
    for name in filters:
        if name in df.columns:
            some = some | (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    return some


def route(df: DataFrame, question: str = "question", filters: list[str] | None = None) -> DataFrame:
    """Columns route and route_reason (pattern, filters or fallback).

    filters names columns of given filters that take part: a topic with words for trends or experts goes to hybrid before the tables are
    tried, any other filter with words for a list goes to the tables before vector search is, and what nothing tells goes to hybrid
    where a topic is given, else to vector search.
    """
    q = F.lower(F.col(question))
    given = filters or []
    topic = _set(df, [c for c in given if c == "topic_name"])
    rows = _set(df, [c for c in given if c in ROW_FILTERS])
    told = {name: F.coalesce(q.rlike(pattern), F.lit(False)) for name, pattern in ROUTES}
    by_topic, by_rows = topic & q.rlike(TREND_WORDS), rows & q.rlike(LISTING_WORDS)
    found = F.when(told["graph"], "graph").when(told["hybrid"] | by_topic, "hybrid").when(told["sql"] | by_rows, "sql").when(told["vector"], "vector")
    by_filter = ~told["graph"] & ~told["hybrid"] & (by_topic | (~told["sql"] & by_rows))
    reason = F.when(found.isNull(), "fallback").when(by_filter, "filters").otherwise("pattern")
    return df.withColumn("route", F.coalesce(found, F.when(topic, "hybrid").otherwise("vector"))).withColumn("route_reason", reason)


def topic_words(df: DataFrame, question: str = "question") -> DataFrame:
    """Column topic_words: the given topic or keyword (columns topic_name, keyword, if there), else the question's words after a word that leads to a topic."""
    given = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("topic_name", "keyword") if c in df.columns]
    said = F.regexp_extract(F.col(question), rf"(?i)\b(?:{TOPIC_AFTER})\s+([a-zA-Z0-9&+\s-]+?)(?:\s+(?:{TOPIC_BEFORE})\b|\s*\?|\s*$)", 1)
    said = F.trim(F.regexp_replace(said, r"(?i)^(?:(?:topik|bidang|riset|terapi|teknologi|domain|the)\s+)+", ""))
    return df.withColumn("topic_words", F.coalesce(*given, F.nullif(said, F.lit(""))))


def intent(df: DataFrame, question: str = "question") -> DataFrame:
    return df.withColumn("intent", first_match(F.col(question), INTENTS, None))


def years(df: DataFrame, question: str = "question") -> DataFrame:
    """Columns year_op, year_from, year_to: between, after, before, signs, then a bare year; years out of range do not count."""
    q = F.lower(F.col(question))
    span = r"(?:between|from|antara|dari)\s+(\d{4})\s*(?:and|to|dan|hingga|sampai|-)\s*(\d{4})|(\d{4})\s*(?:-|–|—|to|dan|hingga|sampai|s/d)\s*(\d{4})"
    found = {
        "low": (span, 1), "high": (span, 2), "low_alone": (span, 3), "high_alone": (span, 4),
        "after": (r"\b(?:after|since|from|setelah|sejak)\s+(?:tahun\s+)?(\d{4})", 1), "before": (r"\b(?:before|until|up to|sebelum|hingga|sampai)\s+(?:tahun\s+)?(\d{4})", 1),
        "over": (r">\s*(\d{4})", 1), "under": (r"<\s*(\d{4})", 1), "bare": (r"\b(\d{4})\b", 1),
    }
    # Each year is a column before it is used more than once, so that no pattern is matched or compiled twice.
    name = {k: f"_year_{k}_{len(df.columns)}" for k in found}
    read = df.withColumns({name[k]: F.nullif(F.regexp_extract(q, pattern, group), F.lit("")).cast("int") for k, (pattern, group) in found.items()})
    read = read.withColumns({n: F.when(F.col(n).between(YEAR_LOW, YEAR_HIGH), F.col(n)) for n in name.values()})
    y = {k: F.col(n) for k, n in name.items()}
    a, b = F.coalesce(y["low"], y["low_alone"]), F.coalesce(y["high"], y["high_alone"])
    cases = [  # whether it holds, then operator, from and to
        (a.isNotNull() & b.isNotNull(), "between", F.least(a, b), F.greatest(a, b)),
        (y["after"].isNotNull(), "gte", y["after"], F.lit(None)),
        (y["before"].isNotNull(), "lte", F.lit(None), y["before"]),
        (y["over"].isNotNull(), "gt", y["over"], F.lit(None)),
        (y["under"].isNotNull(), "lt", F.lit(None), y["under"]),
        (y["bare"].isNotNull(), "eq", y["bare"], y["bare"]),
    ]

    def first(at: int) -> Column:
        out = F.lit(None)
        for case in reversed(cases):
            out = F.when(case[0], F.lit(case[at]) if at == 1 else case[at]).otherwise(out)
        return out

    return read.withColumns({"year_op": first(1).cast("string"), "year_from": first(2).cast("int"), "year_to": first(3).cast("int")}).drop(*name.values())


def names(df: DataFrame, question: str = "question") -> DataFrame:
    """Columns author_name and institution_name: quoted or capitalised words after by/author and at/from/institution."""
    q = F.col(question)

    def after(words: str) -> Column:
        found = F.regexp_extract(q, rf"(?i:\b(?:{words}))\s+(?:\"([^\"]+)\"|([A-Z][\w#.]*(?:\s+[A-Z#][\w#.]*)*))", 1)
        plain = F.regexp_extract(q, rf"(?i:\b(?:{words}))\s+(?:\"([^\"]+)\"|([A-Z][\w#.]*(?:\s+[A-Z#][\w#.]*)*))", 2)
        return F.nullif(F.coalesce(F.nullif(found, F.lit("")), plain), F.lit(""))

    return df.withColumns({"author_name": after("by|author|with|oleh|penulis|dengan"), "institution_name": after("at|institution|university|institusi|universitas")})


def hybrid_kind(df: DataFrame, question: str = "question") -> DataFrame:
    """Columns hybrid_kind (trends, experts; combined for both or neither) and emerging_only."""
    q = F.lower(F.col(question))
    trend = q.rlike(r"\b(?:tren|emerging|growing|growth|evol|perkembangan|akselerasi|acceleration|berkembang)")
    expert = q.rlike(rf"\b(?:expert|pakar|ahli|kepakaran|{AUTHORS}|who|siapa|terkemuka)")
    kind = F.when(trend & ~expert, "trends").when(expert & ~trend, "experts").otherwise("combined")
    return df.withColumns({"hybrid_kind": kind, "emerging_only": q.rlike(r"\bemerging\b|\b(?:topik|bidang)\s+(?:berkembang|baru)\b")})


def graph_template(df: DataFrame, question: str = "question") -> DataFrame:
    q = F.lower(F.col(question))
    kind = F.when(q.rlike(r"\b(?:path|connect|jalur|terhubung)"), "paths").when(q.rlike(r"\bkeyword|\bkata kunci"), "keyword_institutions")
    return df.withColumn("graph_template", kind.when(q.rlike(r"\b(?:co-?author|researcher|rekan penulis|peneliti)"), "coauthors").otherwise("partners"))


def fold_years(df: DataFrame) -> DataFrame:
    """Filters with the years that the question states, where none are given; dropped_op names operators that filters cannot say."""
    given = F.col("filter_year").isNotNull() | F.col("filter_from").isNotNull() | F.col("filter_to").isNotNull()
    op = F.col("year_op")
    return df.withColumns({
        "filter_year": F.when(~given & (op == "eq"), F.col("year_from")).otherwise(F.col("filter_year")),
        "filter_from": F.when(~given & op.isin("gte", "between"), F.col("year_from")).otherwise(F.col("filter_from")),
        "filter_to": F.when(~given & op.isin("lte", "between"), F.col("year_to")).otherwise(F.col("filter_to")),
        "dropped_op": F.when(~given & op.isin("gt", "lt"), op),
    })


def read(df: DataFrame, question: str = "question", filters: list[str] | None = None) -> DataFrame:
    """All of the above on a questions table; filters as in route."""
    out = request_limit(names(years(intent(route(df, question, filters), question), question), question), question)
    return topic_words(graph_template(hybrid_kind(out, question), question), question)


def ignored(df: DataFrame, filters: list[str]) -> DataFrame:
    """Column filters_ignored: set filters that the question's route does not use."""
    cases = None
    for name, used in USED.items():
        each = ignored_filters(used, filters)
        cases = F.when(F.col("route") == name, each) if cases is None else cases.when(F.col("route") == name, each)
    return df.withColumn("filters_ignored", cases)
