"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 9)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import unused

WINDOW = 13
#: Bytes of text that a shift block spans; longer blocks are rarer and so give longer shifts.
BLOCK = 8
#: Bytes of benchmark windows that are searched in one pass; a larger benchmark takes several passes over the documents.
PASS_BYTES = 32 << 20

_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of bytes outside 00-2F, 3A-60 and 7B-7F."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Finds every occurrence of byte patterns of similar length: block shift table, suffix buckets, direct comparison."""

    def __init__(self, patterns: list[bytes]):
        self.reach = min(map(len, patterns))
        self.block = min(BLOCK, self.reach)
        self.far = self.reach - self.block + 1
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.reach + 1):
                b = p[end - self.block : end]
                shift[b] = min(shift.get(b, self.far), self.reach - end)
            buckets[p[self.reach - self.block : self.reach]].append(p)
        self.shift, self.buckets = shift, dict(buckets)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, overlapping ones too."""
        at, end, width, far, get = self.reach, len(text), self.block, self.far, self.shift.get
        while at <= end:
            block = text[at - width : at]
            step = get(block, far)
            if step:
                at += step
                continue
            start = at - self.reach
            for p in self.buckets[block]:
                if text.startswith(p, start):
                    yield start, p
            at += 1


class Matcher:
    """Windows of benchmark items -> which words of a text they cover, and which items occur."""

    def __init__(self, windows: dict[bytes, list[int]]):
        self.items = windows
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for p in windows:
            by_length[len(p).bit_length() if len(p) < 48 else 6].append(p)  # a short pattern would shorten every shift
        self.searches = [WuManber(p) for p in by_length.values()]

    def search(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered word ranges [from, to), merged, and item ids."""
        text = b" " + b" ".join(found) + b" "
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for s in self.searches:
            for start, p in s.occurrences(text):
                spans.append((start, start + len(p)))
                items.update(self.items[p])
        out: list[tuple[int, int]] = []
        counted = before = 0
        for a, b in _merged(sorted(spans)):
            counted += text.count(b" ", before, a)
            n = text.count(b" ", a, b) - 1
            out.append((counted, counted + n))
            before = a
        return out, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, each with the space on both sides, joined where they share a word."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1] - 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def windows_of(item: list[bytes]) -> list[bytes]:
    """Windows of an item's words as byte patterns with a space on both sides."""
    return [b" " + b" ".join(item[i : i + WINDOW]) + b" " for i in range(max(1, len(item) - WINDOW + 1))] if item else []


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's items in passes, each with a bounded size; rows come one partition at a time."""
    items, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        n = len(row.t) * WINDOW
        if items and size + n > PASS_BYTES:
            yield items
            items, size = [], 0
        items.append((row.i, row.t))
        size += n
    if items:
        yield items


_HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def _search_udf(spark, items: list[tuple[str, str]]):
    """A column function text -> hits for one pass of items."""
    windows: dict[bytes, list[str]] = defaultdict(list)
    for item_id, text in items:
        for w in windows_of(words(text)):
            if item_id not in windows[w]:
                windows[w].append(item_id)
    sent = spark.sparkContext.broadcast(dict(windows))  # at most PASS_BYTES and one item
    state: dict[str, Matcher] = {}

    def search(texts: pa.Array) -> pa.Array:
        if "m" not in state:
            state["m"] = Matcher(sent.value)
        out = []
        for t in texts:
            found = words(t.as_py() or "")
            spans, hit = state["m"].search(found)
            out.append({"n_words": len(found), "n_hit": sum(b - a for a, b in spans), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(x for x in hit if x is not None)})
        return pa.array(out, _ARROW)

    return F.arrow_udf(search, _HITS)


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """docs with one struct column `out` more: n_words, n_hit, spans (word ranges), items (ids as strings, sorted), contaminated.

    Words are those of `words`; null and empty texts have none and are clean. An item's windows are its
    13-word runs, or the whole item if shorter; an item without words has none. Every occurrence of a
    window in a whole text counts, and the words inside are hit. contaminated: n_hit > 0 and at least a
    twentieth of the words. Equal items each count; repeated ones (same id) once. Other columns of docs come back as they are, whatever their names. No rows are shuffled;
    a benchmark over PASS_BYTES is searched in passes that each hold a bounded part of it.
    """
    spark = docs.sparkSession
    cols = docs.columns
    text = F.col(f"`{text_col}`")
    hits, found = unused(docs, "hits"), unused(docs, "found")
    df = docs.withColumn(hits, F.lit(None).cast(f"array<{_HITS}>"))
    first = True
    for items in _passes(benchmark, item_id, item_text):
        one = F.array(_search_udf(spark, items)(text))
        df = df.withColumn(hits, one if first else F.concat(hits, one))
        first = False
    if first:
        one = F.array(_search_udf(spark, [])(text))
        df = df.withColumn(hits, one)
    # Passes may hit the same words, so their ranges are merged: a word is hit where any range covers it.
    ranges = F.array_sort(F.flatten(F.transform(hits, lambda h: h["spans"])))
    merged = F.when(F.size(hits) == 1, F.element_at(hits, 1)["spans"]).otherwise(F.aggregate(ranges, F.array().cast("array<struct<start:bigint,stop:bigint>>"), _join_range))
    struct = F.struct(
        F.element_at(hits, 1)["n_words"].alias("n_words"),
        F.aggregate(merged, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"]).alias("n_hit"),
        merged.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))).alias("items"),
    )
    df = df.withColumn(found, struct)
    return df.select(*(F.col(f"`{c}`") for c in cols if c != out), F.struct(f"{found}.*", ((F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * 20 >= F.col(f"{found}.n_words"))).alias("contaminated")).alias(out))


def _join_range(acc, s):
    last = F.element_at(acc, -1)
    joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
    return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))


def items_digest(items) -> str:
    """SHA-256 of item ids, sorted as strings and comma-joined; what the query derives in SQL."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
