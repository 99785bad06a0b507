"""Removal of long repeated passages by longest-previous-factor arrays over bucketed suffixes (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import HOT_SHARE, raw_bytes, slices, text_of, with_group, written
from lodestone.llm.shingles import mixed

LENGTH = 400
#: Bytes of an anchor. Every string of LENGTH bytes holds LENGTH - GRAM + 1 of them, and its least one is its anchor.
GRAM = 48
#: Occurrences of an anchor whose suffixes are sorted in one group; more are salted over several.
GROUP = 1000
#: Suffixes that are sorted at a time.
SUFFIXES = 100_000
#: Bytes whose anchors are found at a time; places within have 24 bits.
PART = 1 << 22
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def anchors(flat: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, first and last start of the strings of `length` bytes that share the anchor, and its place.

    The anchor of a string is its gram of least hash, the leftmost of equals, so equal strings have equal
    anchors at equal places inside, in whatever text they stand. A long buffer is read in overlapping parts.
    """
    parts = [_part(flat[at : at + PART + length - 1], at, ends, length, gram) for at in range(0, max(1, len(flat) - length + 1), PART)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _part(flat: np.ndarray, base: int, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(flat)
    wide = length - gram + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _RADIX, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[flat] * power[:n], dtype=np.uint64)])
    grams = mixed((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    # Hash above, place below: the least of a stretch is the least hash, leftmost. 40 bits of hash decide the order.
    packed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_least(packed, wide) & np.uint64((1 << 24) - 1)).astype(np.int64)
    # Strings that lie in one text only.
    starts = np.arange(len(at)) + base
    of = np.searchsorted(ends, starts, side="right") - 1
    inside = starts + length <= ends[of + 1]
    change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])]))
    stop = np.concatenate([change[1:], [len(at)]]) - 1
    good = inside[change]
    first, last = change[good], stop[good]
    text = of[first]
    own = ends[text] - base
    return text, grams[at[first]].view(np.int64), first - own, last - own, at[first] - own


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


_ANCHOR = pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("place", pa.int32())])
_ANCHORS = "doc_key binary, anchors array<struct<anchor:bigint,first:int,last:int,place:int>>"


def _anchors_of(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, ends = raw_bytes(batch.column("text"))
            text, hashes, first, last, place = anchors(flat, ends, length, gram)
            found = pa.StructArray.from_arrays([pa.array(hashes), *(pa.array(v, pa.int32()) for v in (first, last, place))], fields=list(_ANCHOR))
            at = np.searchsorted(text, np.arange(len(ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.ListArray.from_arrays(pa.array(at), found)], ["doc_key", "anchors"])

    return run


def repeated(buffer: bytes, starts: list[int], length: int) -> np.ndarray:
    """Which of the suffixes at `starts` (ascending) share their first `length` bytes with another one.

    Suffixes are sorted by those bytes. The longest previous factor of a suffix is its longest common
    prefix with the nearest smaller places before and after it in that order; whether it reaches `length`
    shows at the neighbours, as equal suffixes stand together. The later ones find the first one so, and
    it is marked through its next smaller neighbour's factor.
    """
    order = sorted(range(len(starts)), key=lambda k: buffer[starts[k] : starts[k] + length])
    common = np.zeros(len(order) + 1, bool)  # common[r]: ranks r - 1 and r agree on `length` bytes
    for r in range(1, len(order)):
        a, b = starts[order[r - 1]], starts[order[r]]
        common[r] = buffer[a : a + length] == buffer[b : b + length]
    # Previous and next smaller places in suffix order, as far as the common prefix reaches.
    smaller_before, smaller_after = _nearest_smaller(order, common)
    out = np.zeros(len(order), bool)
    for r, k in enumerate(order):
        for s in (smaller_before[r], smaller_after[r]):
            if s >= 0:
                out[k] = out[order[s]] = True  # a later copy, and the earlier one that it copies
    return out


def _nearest_smaller(order: list[int], common: np.ndarray) -> tuple[list[int], list[int]]:
    before, after, stack = [-1] * len(order), [-1] * len(order), []
    for r, k in enumerate(order):
        if not common[r]:
            stack.clear()
        while stack and order[stack[-1]] > k:
            after[stack.pop()] = r
        if stack:
            before[r] = stack[-1]
        stack.append(r)
    return before, after


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]


_CONTEXTS = "doc_key binary, anchor long, salt int, salts int, offset int, firsts array<int>, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each repeated anchor of a text the bytes from its first to its last string.

    Where a text repeats them at the same offset from the anchor, as periodic text does at every place,
    they are sent once with all their places.
    """
    for batch in batches:
        for key, text, rows in zip(batch.column("doc_key").to_pylist(), batch.column("text").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            alike: dict[tuple, list[int]] = {}
            for r in rows:
                alike.setdefault((r["anchor"], r["salt"], r["salts"], r["first"] - r["place"], data[r["first"] : r["last"] + r["length"]]), []).append(r["first"])
            found = list(alike.items())
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                columns = [pa.array([k[c] for k, _ in part], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
                firsts = pa.array([f for _, f in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.binary()), *columns[:4], firsts, columns[4]], ["doc_key", "anchor", "salt", "salts", "offset", "firsts", "bytes"])


_MARKED = "doc_key binary, first int, last int, window binary"


def _group_marks(length: int):
    """Marks of one group of occurrences: runs of repeated starts, and for a salted group each other window by its digest.

    An occurrence is (text, offset of its first string from the anchor, places of that string, bytes).
    """

    def marks(rows: list[tuple], salted: bool):
        """Which strings of each occurrence stand in another one too; in a salted group also each string once, by its digest."""
        # Equal strings stand at equal offsets from the anchor, so offsets are taken a few at a time.
        low = min(r[1] for r in rows)
        high = max(r[1] + len(r[3]) - length for r in rows)
        step = max(1, SUFFIXES // len(rows))
        buffer, bases, at = b"".join(r[3] for r in rows), [], 0
        for r in rows:
            bases.append(at)
            at += len(r[3])
        found: list[list[int]] = [[] for _ in rows]
        told: list[tuple[int, int, bytes]] = []
        for offset in range(low, high + 1, step):
            starts, who, where = [], [], []
            for k, (_, own, _, b) in enumerate(rows):
                for o in range(max(offset, own), min(offset + step - 1, own + len(b) - length) + 1):
                    starts.append(bases[k] + o - own)
                    who.append(k)
                    where.append(o - own)
            mark = repeated(buffer, starts, length).tolist()
            seen = set()
            for s, k, w, m in zip(starts, who, where, mark, strict=True):
                if m:
                    found[k].append(w)
                if salted:
                    digest = hashlib.blake2b(buffer[s : s + length], digest_size=16).digest()
                    if not m or digest not in seen:
                        told.append((k if not m else -1, w, digest))
                        seen.add(digest)
        return found, told

    def merged(rows: list[tuple], salted: bool):
        """As marks, but occurrences with the same bytes around are one: all their strings are repeated."""
        alike: dict[tuple[int, bytes], list[int]] = {}
        for k, (_, offset, _, b) in enumerate(rows):
            alike.setdefault((offset, b), []).append(k)
        some = [rows[same[0]] for same in alike.values()]
        found, told = marks(some, salted) if len(some) > 1 or salted else ([[]], [])
        out: list[list[int] | range] = [[] for _ in rows]
        alone = []
        for same, places in zip(alike.values(), found, strict=True):
            alone.append(len(same) == 1 and len(rows[same[0]][2]) == 1)
            for k in same:
                out[k] = places if alone[-1] else range(len(rows[k][3]) - length + 1)
        # A string that stands in several alike occurrences is settled: it is only told to the other groups.
        heads = [same[0] for same in alike.values()]
        return out, [(heads[k] if k >= 0 and alone[k] else None, w, d) for k, w, d in told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["doc_key", "first", "last", "window"])
            out.clear()
            return batch

        def finish(rows: list[tuple], salted: bool) -> None:
            if sum(len(r[2]) for r in rows) < 2 and not salted:
                return
            found, told = merged(rows, salted)
            for (key, _, firsts, _), places in zip(rows, found, strict=True):
                if len(places):
                    for a, z in zip(*_runs(np.array(sorted(places))), strict=True):
                        out.extend((key, f + int(a), f + int(z), None) for f in firsts)
            for k, w, digest in told:
                at = rows[k][2][0] + w if k is not None else 0
                out.append((rows[k][0] if k is not None else None, at, at, digest))

        now, held, salted = None, [], False
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i in range(batch.num_rows):
                group = (columns["anchor"][i], columns["salt"][i])
                if group != now:
                    if held:
                        finish(held, salted)
                        if len(out) > 20_000:
                            yield flush()
                    now, held, salted = group, [], columns["salts"][i] > 1
                held.append((columns["doc_key"][i], columns["offset"][i], columns["firsts"][i], columns["bytes"][i]))
        if held:
            finish(held, salted)
        yield flush()

    return run


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:bigint,stop:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for m in sorted(marks or [], key=lambda m: m["first"]):
                    a, z = m["first"], m["last"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                kept, at = [], 0
                for a, z in spans:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                rows.append((doc, len(data), sum(z - a for a, z in spans), len(spans), b"".join(kept), [{"start": a, "stop": z} for a, z in spans]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), _SPAN))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay), removed (byte ranges).

    A byte is removed when it lies in a string of `length` bytes that also starts elsewhere, in the same
    document or another; all such copies go, strings are those of the input and never cross documents.
    Null counts as empty; texts shorter than `length` stay whole. Rows that repeat a text, with or without
    its doc_id, are copies of each other.

    Strings that are equal have the same anchor, so only texts' anchors are compared over all documents;
    bytes travel only for anchors that occur again. Equal texts go through that once. An anchor with more than
    GROUP occurrences is salted; what a salted group leaves open is settled by window digests, of which
    each group sends one.
    """
    key = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    rows = text_of(docs, id_col, text_col).withColumn("doc_key", key)
    long_ = rows.filter(F.octet_length("text") >= length)
    keys = written(long_.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")), "texts")
    found = long_.select("doc_key", "text").mapInArrow(_anchors_of(length, gram), _ANCHORS)
    found = written(found.groupBy("doc_key").agg(F.any_value("anchors").alias("anchors")), "anchors")
    each = found.select("doc_key", F.inline("anchors"))
    counts = written(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, total * HOT_SHARE)
    # Anchors with a thousandth of the occurrences number a thousand at most.
    hot = each.join(F.broadcast(counts.filter(F.col("n") >= least)), "anchor")
    cold = each.join(counts.filter(F.col("n") < least), "anchor")
    salts = F.ceil(F.col("n") / GROUP).cast("int")
    again = hot.unionByName(cold).withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("doc_key", "first"), salts).cast("int"))
    by_text = again.groupBy("doc_key").agg(F.collect_list(F.struct("anchor", "salt", "salts", "first", "last", "place", F.lit(length).alias("length"))).alias("anchors"))
    texts = long_.groupBy("doc_key").agg(F.any_value("text").alias("text")).join(by_text, "doc_key")
    contexts = texts.mapInArrow(_contexts, _CONTEXTS)
    marked = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_group_marks(length), _MARKED)
    marked = written(marked, "marks")
    # Windows of salted groups: those that another group has too are repeated. A group sends a window once.
    open_ = marked.filter("window is not null")
    twice = open_.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("doc_key").isNotNull(), F.struct("doc_key", "first", "last"))).alias("asked")).filter("n > 1")
    settled = twice.select(F.explode("asked").alias("a")).select("a.*")
    copies = keys.filter("n > 1")
    marks = marked.filter("window is null").select("doc_key", "first", "last").unionByName(settled).join(copies, "doc_key", "left_anti")
    by_key = marks.groupBy("doc_key").agg(F.collect_list(F.struct("first", "last")).alias("marks")).withColumn("n", F.lit(1).cast("long"))
    whole = copies.select("doc_key", F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"))).alias("marks"), "n")
    groups = written(by_key.unionByName(whole), "removed")
    joined = with_group(rows, groups, "doc_key", "n", F.xxhash64("doc_id", "text"))
    full = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("text") - length).alias("last")))).otherwise(F.col("marks"))
    return joined.select("doc_id", "text", full.alias("marks")).mapInArrow(_cut(length), _KEPT)
