"""N-gram Jaccard join over a MinHash LSH forest with exact verification (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import raw_bytes, slices, text_of, with_group, written
from lodestone.llm.components import components
from lodestone.llm.shingles import mixed, shingle_sets

SIMILARITY = 0.8
#: Prefix tries, values of a signature in each, and the share of pairs at SIMILARITY that must be able to meet in some trie.
TREES, DEPTH, RECALL = 20, 8, 0.9999
#: The share of pairs at the threshold that must be able to meet where no link near it has been met.
UNSEEN_RECALL = 0.999
#: Members of a trie node, and shingles of them, that are compared in one piece; a larger node is compared in pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: Shared shingles whose occurrences are multiplied at a time.
COLUMNS = 4096


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two sets share a prefix of `depth` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The shortest prefix that can be needed: there pairs at `similarity` meet with the target recall."""
    while depth > 1 and meeting(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def shortened(found: set[int], similarity: float, least: int, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of every similarity that links were found at meet with the target recall, and any pair with UNSEEN_RECALL.

    found: similarities of links, in whole hundredths, rounded down; the least one decides, however few its links are
    beside those of near-identical copies. `least` is the depth that is enough at the threshold. Links of a similarity at which none has met on
    longer prefixes are told by those that meet on the shorter ones, and prefixes are shortened again.
    """
    depth = DEPTH
    while depth > least and (meeting(similarity, depth) < UNSEEN_RECALL or any(meeting(s / 100, depth) < recall for s in found)):
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def prefix_keys(sets: list[np.ndarray], least: int, trees: int = TREES) -> np.ndarray:
    """[set, depth - least, trie]: the trie node of each set's prefix of each depth from `least` to DEPTH, in 32 bits.

    A node's number is made from its parent's and the next MinHash value. Sets are not empty.
    """
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factor, plus = _seeds(trees * DEPTH)
    out = np.empty((len(sets), DEPTH - least + 1, trees), np.int32)
    for tree in range(trees):
        key = np.full(len(sets), tree + 1, np.uint64)
        for level in range(DEPTH):
            j = tree * DEPTH + level
            key = mixed(key * np.uint64(31) + np.minimum.reduceat((flat * factor[j] + plus[j]) >> np.uint64(32), starts))
            if level + 1 >= least:
                out[:, level + 1 - least, tree] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit key of each set; equal sets have equal keys."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sizes = np.array([len(s) for s in sets], np.uint64)
    halves = [mixed(np.add.reduceat(mixed(flat ^ np.uint64(salt)), starts) + sizes) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    packed = np.column_stack(halves).astype(">u8")
    return [row.tobytes() for row in packed]


def _signatures(least: int):
    width = TREES * (DEPTH - least + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*raw_bytes(batch.column("text")))
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            held = [sets[i] for i in some]
            keys = prefix_keys(held, least)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, width, dtype=np.int32)), pa.array(keys.ravel()))
            taken = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("row_key"), pa.array(set_keys(held), pa.binary()), pa.array([len(s) for s in held], pa.int64()), arrays], ["doc_id", "row_key", "set_key", "n_shingles", "nodes"])

    return run


def shared(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None = None) -> np.ndarray:
    """Shingles that each set of a shares with each of b (of a itself without b), exact."""
    every = [*sets_a, *(sets_b or [])]
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    used = count[column] > 1  # what a single set has is shared with none
    owner, column = owner[used], (np.cumsum(count > 1) - 1)[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = len(sets_a)
    out = np.zeros((n, len(sets_b) if sets_b is not None else n), np.int64)
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        piece = np.zeros((len(every), min(COLUMNS, columns - at)), np.float32)
        piece[owner[a:b], column[a:b] - at] = 1
        out += (piece[:n] @ (piece[n:] if sets_b is not None else piece).T).astype(np.int64)  # COLUMNS at most, exact in float
    return out


def _first_tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first trie in which each pair shares a prefix (TREES if none): every pair is compared in that one only."""
    out = np.full((len(a), len(b)), TREES, np.int16)
    for tree in range(TREES - 1, -1, -1):
        out[a[:, tree][:, None] == b[:, tree][None, :]] = tree
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys, of a partition sorted by them, as columns."""
    now, held = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() if c not in ("shingles", "prefixes", "before") else [np.asarray(x.values) if x.values is not None else None for x in batch.column(c)] for c in batch.schema.names}
        for i in range(batch.num_rows):
            key = tuple(columns[k][i] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, {c: [] for c in columns}
            for c, v in columns.items():
                held[c].append(v[i])
    if held:
        yield now, held


NODE = ["tree", "prefix", "block_a", "block_b"]
_NODE = "tree int, prefix int, block_a int, block_b int"


def _sides(rows: dict[str, list], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    block = np.array(rows["block"])
    return (np.flatnonzero(block == a), np.flatnonzero(block == b)) if a != b else (np.arange(len(block)),) * 2


def _pairs(rows: dict[str, list], x: np.ndarray, y: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs are compared in this trie: it is the first in which they share the prefix, and they shared no longer one."""
    now, before = np.array(rows["prefixes"]), np.array(rows["before"])
    pairs = _first_tree(now[x], now[y]) == tree
    if before.shape[1]:
        pairs &= _first_tree(before[x], before[y]) == TREES
    return pairs


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node piece, the members that have a partner whose first shared trie is this one."""
    for (tree, prefix, a, b), rows in _groups(batches, NODE):
        x, y = _sides(rows, a, b)
        pairs = _pairs(rows, x, y, tree)
        if a == b:
            np.fill_diagonal(pairs, False)
        some = np.zeros(len(rows["block"]), bool)
        some[x[pairs.any(1)]] = True
        some[y[pairs.any(0)]] = True
        keep = np.flatnonzero(some)
        n = len(keep)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int32()) for v in (tree, prefix, a, b)] + [pa.array([rows["block"][i] for i in keep], pa.int32()), pa.array([rows["set_key"][i] for i in keep], pa.binary())], [*NODE, "block", "set_key"])


def _linked(similarity: float):
    """Verify the pairs of each node piece; a row for each member with its links, and a spanning forest of them.

    A row without set_key counts a piece's links of one similarity, in steps of a hundredth.
    """
    ratio = Fraction(similarity).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, a, b), rows in _groups(batches, NODE):
            x, y = _sides(rows, a, b)
            sets, docs = [s.view(np.uint64) for s in rows["shingles"]], np.array(rows["n_docs"], np.int64)
            pairs = _pairs(rows, x, y, tree)
            size = np.array([len(s) for s in sets], np.int64)
            common = shared([sets[i] for i in x], None if a == b else [sets[i] for i in y])
            union = size[x][:, None] + size[y][None, :] - common
            pairs &= ratio.denominator * common >= ratio.numerator * union
            if a == b:
                np.fill_diagonal(pairs, False)
            told, n_told = np.unique(100 * common[pairs] // union[pairs], return_counts=True)
            links = np.zeros(len(sets), np.int64)
            np.add.at(links, x, pairs @ docs[y])
            if a != b:
                np.add.at(links, y, pairs.T @ docs[x])
            root = _forest(pairs, x, y, len(sets))
            keep = np.flatnonzero(links)
            key = rows["set_key"]
            if len(keep):
                k = [key[i] for i in keep] + [None] * len(told)
                n = np.concatenate([links[keep], n_told // (2 if a == b else 1)])
                j = [key[root[i]] for i in keep] + [None] * len(told)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(j, pa.binary()), pa.array([None] * len(keep) + told.tolist(), pa.int64())], ["set_key", "links", "joined", "similarity"])

    return run


def _forest(pairs: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A member of the own component for each of n members, the same for all of it."""
    root = np.arange(n)
    adjacent = np.zeros((n, n), bool)
    adjacent[np.ix_(x, y)] |= pairs
    adjacent |= adjacent.T
    left = np.ones(n, bool)
    for i in range(n):
        if left[i]:
            reach = np.zeros(n, bool)
            reach[i] = True
            while True:
                wider = reach | adjacent[reach].any(0)
                if (wider == reach).all():
                    break
                reach = wider
            root[reach] = i
            left &= ~reach
    return root


def _sets_of_needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(*raw_bytes(batch.column("text")))
        # A doc_id may be repeated with another text: only the text that the key was made from counts.
        some = [i for i, s in enumerate(sets) if len(s)]
        made = dict(zip(some, set_keys([sets[i] for i in some]) if some else [], strict=True))
        right = [i for i, key in enumerate(batch.column("set_key").to_pylist()) if made.get(i) == key]
        batch, sets = batch.take(pa.array(right, pa.int32())), [sets[i] for i in right]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["set_key", "shingles"])


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, kept.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles (words between
    white space, A-Z lower-cased; a shorter text is one shingle) is at least `similarity`. A class is a
    connected component of links and class_id its least doc_id, which is kept; n_links counts the other
    documents linked to this one, copies too. Documents without words (null, empty, blank) link to none.
    Equal sets are handled once. Sets are first compared with those that share a whole signature in some trie; prefixes are
    then shortened until pairs of every similarity that links were found at meet with the target recall, and pairs that
    meet on shorter ones are compared too.
    Every pair is verified on whole sets, in whole numbers, in the first trie that it shares; a trie node of more than
    BLOCK members is verified in pairs of blocks, so no task holds more. Rows that repeat a doc_id are counted as
    documents of their own; a null doc_id gets the least other id of its class.
    """
    least = prefix_depth(similarity, recall=recall)
    rows = text_of(docs, id_col, text_col).withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))
    signed = written(rows.mapInArrow(_signatures(least), "doc_id long, row_key long, set_key binary, n_shingles long, nodes array<int>"), "signatures")
    sets = written(signed.groupBy("set_key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("nodes").alias("nodes")), "sets")

    def nodes(depth: int) -> Column:
        return F.slice("nodes", (depth - least) * TREES + 1, TREES)

    def compared(depth: int, before: int | None) -> DataFrame:
        """Links of pairs that share a prefix of `depth` values, but none of `before`."""
        at = sets.select("set_key", "n_docs", "row_key", "n_shingles", nodes(depth).alias("prefixes"), (nodes(before) if before else F.array().cast("array<int>")).alias("before"))
        # Trie nodes with more than one set, and their members; a set is in one node of each trie.
        members = at.select("set_key", "n_shingles", F.posexplode("prefixes").alias("tree", "prefix"))
        held = members.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).filter("members > 1")
        members = members.drop("n_shingles").join(held, ["tree", "prefix"]).join(at.select("set_key", "prefixes", "before"), "set_key")
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.least(F.col("members"), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
        members = members.withColumn("block", F.pmod(F.xxhash64("set_key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pieces = members.select("tree", "prefix", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "set_key", "prefixes", "before")
        needed = pieces.repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(_needed, f"{_NODE}, block int, set_key binary")
        needed = written(needed, "candidates")
        wanted = needed.select("set_key").distinct().join(at, "set_key").select("set_key", "row_key")
        texts = rows.join(wanted, "row_key").select("set_key", "text")
        shingles = texts.mapInArrow(_sets_of_needed, "set_key binary, shingles array<long>").dropDuplicates(["set_key"])
        shingles = shingles.join(at.select("set_key", "prefixes", "before", "n_docs"), "set_key")
        pieces = needed.join(shingles, "set_key").repartition(*NODE).sortWithinPartitions(*NODE)
        return written(pieces.mapInArrow(_linked(similarity), "set_key binary, links long, joined binary, similarity long"), "links")

    def told(links: DataFrame) -> set[int]:
        return {r.similarity for r in links.filter("set_key is null").select("similarity").distinct().collect()}  # 101 rows at most

    depth, found = DEPTH, compared(DEPTH, None)
    met = told(found)
    while (shorter := shortened(met, similarity, least)) < depth:
        more = compared(shorter, depth)
        found, depth, met = found.unionByName(more), shorter, met | told(more)
    found = found.filter("set_key is not null")
    roots = components(found.select(F.col("set_key").alias("u"), F.col("joined").alias("v")))
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    classed = sets.select("set_key", "n_docs", "doc_id").join(roots, F.col("set_key") == F.col("node"), "left").join(links, "set_key", "left")
    classed = classed.select("set_key", "n_docs", "doc_id", F.coalesce("root", "set_key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    classes = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n_docs").alias("class_size"))
    of_set = written(classed.join(classes, "root").select("set_key", "class_id", "class_size", "n_links", "n_docs"), "classes")
    wordless = rows.select("doc_id", (F.length(F.regexp_replace("text", "[\t-\r ]+", "")) == 0).alias("_blank")).filter("_blank").select("doc_id")
    joined = with_group(signed.select("doc_id", "set_key"), of_set, "set_key", "n_docs", F.xxhash64("doc_id")).select("doc_id", "class_id", "class_size", "n_links")
    alone = wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
