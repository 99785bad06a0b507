"""Exact dedup over a cuckoo-filter index of live digests (operator 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_of, with_group, written

SLOTS, KICKS = 4, 64
#: A task sends on what it has after so many live digests: before the shuffle at any row, after it between two buckets.
FLUSH_KEYS = 200_000
#: Digests with the same first hex digits are a bucket of the index: a million buckets, each read by one task in one run.
BUCKET_DIGITS = 5
#: Bits of the map of digests that may be shared; 16 MB whatever the data.
MAP_BITS = 1 << 27
GROUPS = "digest string, keep_id long, group_size long"


def sha256(text: Column) -> Column:
    """The digest of a text, in lowercase hex."""
    return F.sha2(text, 256)


def _bucket() -> Column:
    return F.substring("digest", 1, BUCKET_DIGITS)


class CuckooIndex:
    """A cuckoo filter whose slots also keep the key and its value.

    Lookups compare 16-bit fingerprints in two buckets of four slots; a fingerprint hit is verified
    against the key stored at that slot, so it never gives a false answer. When a chain of kicks is
    too long the table doubles and is filled again from the stored keys. Keys are hex digests.
    """

    def __init__(self, buckets: int = 1024):
        self.live = 0
        self._table(buckets)

    def _table(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[str | None] = [None] * (buckets * SLOTS)
        self.values: list[list | None] = [None] * (buckets * SLOTS)

    def _places(self, key: str) -> tuple[int, int, int]:
        number = int(key[:16], 16)
        print_ = (number >> 40) % 65535 + 1
        one = (number & 0xFFFFFFFF) & self.mask
        return print_, one, self._other(one, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995 & 0xFFFFFFFF)) & self.mask

    def find(self, key: str) -> list | None:
        """The value of a live key, else None."""
        print_, one, two = self._places(key)
        prints = self.prints
        for first in (one * SLOTS, two * SLOTS):
            for slot in range(first, first + SLOTS):
                if prints[slot] == print_ and self.keys[slot] == key:
                    return self.values[slot]
        return None

    def insert(self, key: str, value: list) -> None:
        """Add a key that is not live."""
        print_, one, two = self._places(key)
        self.live += 1
        for first in (one * SLOTS, two * SLOTS):
            for slot in range(first, first + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = print_, key, value
                    return
        bucket = one
        for kick in range(KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            print_, self.prints[slot] = self.prints[slot], print_
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, print_)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = print_, key, value
                    return
        stored = [*self.items(), (key, value)]
        self._table((self.mask + 1) * 2)
        self.live = 0
        for k, v in stored:
            self.insert(k, v)

    def delete(self, key: str) -> bool:
        """Take a live key out; False if it was not live."""
        print_, one, two = self._places(key)
        for first in (one * SLOTS, two * SLOTS):
            for slot in range(first, first + SLOTS):
                if self.prints[slot] == print_ and self.keys[slot] == key:
                    self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
                    self.live -= 1
                    return True
        return False

    def items(self) -> Iterator[tuple[str, list]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _drain(index: CuckooIndex) -> pa.RecordBatch:
    keys, values = zip(*index.items(), strict=True) if index.live else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], ["digest", "keep_id", "group_size"])


def _merge(live: CuckooIndex, key: str, doc: int | None, n: int) -> None:
    """Count n rows of a digest, the largest id of which is doc."""
    value = live.find(key)
    if value is None:
        live.insert(key, [doc, n])
        return
    value[1] += n
    if doc is not None and (value[0] is None or doc > value[0]):
        value[0] = doc


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size) in any order, folded through a cuckoo index that is sent on when it is full."""
    live = CuckooIndex()
    for batch in batches:
        for key, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _merge(live, key, doc, n)
        if live.live >= FLUSH_KEYS:
            yield _drain(live)
            live = CuckooIndex()
    yield _drain(live)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes (digest, keep_id, group_size, step) by bucket and step: 0 and 2 insert, 1 deletes. Whole buckets are sent on."""
    live, bucket = CuckooIndex(), ""
    for batch in batches:
        for key, doc, n, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key[:BUCKET_DIGITS] != bucket:
                bucket = key[:BUCKET_DIGITS]
                if live.live >= FLUSH_KEYS:
                    yield _drain(live)
                    live = CuckooIndex()
            if step == 1:
                live.delete(key)
            else:
                _merge(live, key, doc, n)
    yield _drain(live)


def _applied(changes: DataFrame) -> DataFrame:
    """The index that the changes lead to. A task holds the live digests of some buckets, not of its whole partition."""
    changes = changes.select("digest", "keep_id", "group_size", "step")
    return changes.repartition("digest").sortWithinPartitions(_bucket(), "step").mapInArrow(_apply, GROUPS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Live digests (digest, keep_id, group_size), one row for each distinct digest of a text.

    Each task first folds its own rows, so a group of copies sends one row per task to the shuffle
    however large it is; the shuffle is by digest and its partitions fold again, bucket by bucket.
    """
    rows = text_of(docs, id_col, text_col).select(digest(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return _applied(rows.mapInArrow(_fold, GROUPS).withColumn("step", F.lit(0)))


def update_index(index: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The index after taking out the digests of `deletes` (a column digest), then adding the rows of `inserts` (an index).

    Deleting takes a digest out with its whole group; digests that are not live are ignored. A bucket
    of the index is a cuckoo index of its own digests, filled from the stored keys. Null digests delete nothing.
    """
    changes = index.withColumn("step", F.lit(0))
    if deletes is not None:
        gone = deletes.filter(F.col("digest").isNotNull()).select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("step"))
        changes = changes.unionByName(gone.distinct())
    if inserts is not None:
        changes = changes.unionByName(inserts.select("digest", "keep_id", "group_size", F.lit(2).alias("step")))
    return _applied(changes)


def _maybe_shared(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose digest may have more than one row, by a map of MAP_BITS bits that is sent to all tasks.

    None is missed. The more shared digests there are, the more others pass too; where the map is
    full, all do, and the comparison reads more than it needs to.
    """
    bit = F.pmod(F.xxhash64("digest"), F.lit(MAP_BITS)) + 1
    part, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    shared = groups.filter("group_size > 1").groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    marked = rows.withColumns({"_own_part": part, "_place": place}).join(F.broadcast(shared), F.col("_own_part") == F.col("_part"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.filter(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).select(*rows.columns)


def collisions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests of rows (digest, text) that stand for more than one content.

    The contents of a shared digest meet in its bucket and are compared in whole. Tasks keep the least
    and the greatest content of a digest before the shuffle, so a group of copies sends one pair per task.
    """
    met = _maybe_shared(rows.select("digest", "text"), groups)
    return met.groupBy("digest").agg(F.min("text").alias("_least"), F.max("text").alias("_greatest")).filter("_least <> _greatest").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty, so all null and empty texts are
    one group. The index finds texts of equal digest, and these are then compared by content, whatever
    their length; where contents of one digest differ, its rows are grouped by content instead. The
    largest doc_id of a group stays. Rows that repeat a doc_id with the same text are each reported,
    counted and kept together; a null doc_id stays only in a group that has no other. An empty table
    gives an empty result; other columns are ignored. digest must give 16 hex digits or more.
    """
    rows = text_of(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    groups = written(build_index(docs, id_col, text_col, digest), "digests")
    clash = written(collisions(rows, groups), "collisions")
    if not clash.isEmpty():
        by_content = F.concat("digest", F.lit(":"), "text")
        own = rows.join(clash, "digest", "left_semi").groupBy(by_content.alias("digest")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = written(groups.join(clash, "digest", "left_anti").unionByName(own), "contents")
        marked = rows.join(clash.select(F.col("digest").alias("_clash")), F.col("digest") == F.col("_clash"), "left")
        rows = marked.withColumn("digest", F.when(F.col("_clash").isNull(), F.col("digest")).otherwise(by_content))
    rows = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"))
    out = with_group(rows, groups, "digest", "group_size", F.xxhash64("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
