"""Column expressions shared by the operators; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds that a caller's limits are held to.
LIMIT_MOST, HOPS_MOST = 50, 3


def year_pred(col: Column, op: str | None, year: int | None = None, low: int | None = None, high: int | None = None) -> Column:
    """A year predicate by operator (eq, gt, gte, lt, lte, between inclusive); true without one."""
    tests = {"eq": lambda: col == year, "gt": lambda: col > year, "gte": lambda: col >= year, "lt": lambda: col < year, "lte": lambda: col <= year, "between": lambda: col.between(low, high)}
    return F.lit(True) if op is None else tests[op]()


def icontains(col: Column, value: Column | str) -> Column:
    """Literal containment regardless of case: no character of the value is a wildcard."""
    return F.contains(F.lower(col), F.lower(value if isinstance(value, Column) else F.lit(value)))


def iequals(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def optional(param: Column, test: Column) -> Column:
    """True where no parameter is given, else the test."""
    return param.isNull() | test


def ignored_filters(used: set[str], given: list[str]) -> Column:
    """Names of given filter columns that are set and not used, in order."""
    return F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in given if c not in used)), lambda x: x.isNotNull())


def clamped(limit: int | None, default: int, most: int = LIMIT_MOST) -> int:
    """A result size within 1 to `most`."""
    return max(1, min(most, default if limit is None else limit))


def normalize_text(col: Column) -> Column:
    """ASCII punctuation away, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(col, r"[!-/:-@\[-`{-~]", "")), r"\s+", " "))


def normalize_title(col: Column) -> Column:
    """Lower case without what is neither a word character nor white space."""
    return F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", "")


def citation(title: Column, year: Column, doi: Column) -> Column:
    """[Title, Year, DOI] with stand-ins for what is missing or blank."""
    def or_(c: Column, other: str) -> Column:
        return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(other))

    return F.format_string("[%s, %s, %s]", or_(title, "Untitled"), or_(year, "n.d."), or_(doi, "no-doi"))


def period_label(year: Column, low: Column, high: Column) -> Column:
    """2023, 2020-2023, 2020-present, up-to-2023 or all-time."""
    return (
        F.when(year.isNotNull(), year.cast("string"))
        .when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string")))
        .when(low.isNotNull(), F.concat(low.cast("string"), F.lit("-present")))
        .when(high.isNotNull(), F.concat(F.lit("up-to-"), high.cast("string")))
        .otherwise("all-time")
    )


def ellipsis(col: Column, most: int) -> Column:
    """Single blanks, cut to `most` characters with an ellipsis."""
    one = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def session_title(col: Column, most: int = 80, default: str = "New session") -> Column:
    """A question cut at a word's end within `most` characters."""
    one = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring(one, 1, most), r"\s\S*$", "")
    return F.when(one == "", F.lit(default)).when(F.length(one) <= most, one).otherwise(cut)


def scope_label(keys: list[str], labels: dict[str, str] | None = None) -> Column:
    """key=value pairs of the set columns, in order; labels: what stands for a key."""
    return F.concat_ws("; ", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{(labels or {}).get(k, k)}="), F.col(k).cast("string"))) for k in keys))


def dot(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors in double precision; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(col: Column, size: int) -> Column:
    inf = float("inf")
    return F.coalesce((F.size(col) == size) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of the words of two normalised titles; equality decides where one has fewer than two."""
    x, y = (F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) < 2) | (F.size(y) < 2), F.when(F.trim(a) == F.trim(b), 1.0).otherwise(0.0)).otherwise(both)


def confidence(similarity: Column) -> Column:
    return F.round(F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)), 4)


def json_array(col: Column, schema: str) -> Column:
    """A JSON array as an array; empty for null, broken or other JSON."""
    return F.when(F.json_array_length(col).isNotNull(), F.coalesce(F.from_json(col, schema), F.array().cast(schema))).otherwise(F.array().cast(schema))


def source_identity(source: Column) -> Column:
    return F.coalesce(source["publication_id"], source["doi"], source["title"])


def tidy(col: Column) -> Column:
    """Blanks and punctuation put right after something was taken out."""
    out = F.regexp_replace(col, r"\(\s*\)", "")
    out = F.regexp_replace(out, r"[ \t]+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def plain_number(x: Column) -> Column:
    """A double as text with digits alone: 0.0005 and 20000000.0 where a cast gives 5.0E-4 and 2.0E7 (ten decimals, up to 1e15)."""
    digits = F.regexp_replace(x.cast("decimal(26,10)").cast("string"), "(\\.\\d+?)0+$", "$1")
    size = F.abs(x)
    return F.when((size > 0) & (size < 1e-3) & (size >= 1e-10) | (size >= 1e7) & (size < 1e15), digits).otherwise(x.cast("string"))
