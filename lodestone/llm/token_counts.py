"""Token counts by dynamic programming over a trie of distinct pre-tokens (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.pieces import LONG_WORD, LOW, PATH, UNKNOWN, Lattice, Vocabulary, pretokens

#: Pre-tokens that a task remembers, and characters of text that it reads, before it counts anew; cells of a trie's table.
REMEMBERED, AT_ONCE, CELLS = 250_000, 1 << 19, 1 << 21
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


class Trie:
    """A trie of sorted words, level by level: each level's nodes are the distinct prefixes of that length."""

    def __init__(self, lattice: Lattice, words: list[str]):
        width = max(map(len, words))
        code = lattice.codes(words, width)
        order = np.lexsort(code.T[::-1])
        self.order, self.code = order, code[order]
        self.size = np.array([len(words[i]) for i in order])
        new = np.ones((len(words), width + 1), bool)
        new[1:, 0] = False
        if len(words) > 1:
            differs = self.code[1:] != self.code[:-1]
            new[1:, 1:] = np.logical_or.accumulate(differs, axis=1)
        self.node = np.cumsum(new, axis=0, dtype=np.int32) - 1  # [word, depth] -> node of that level; padding counts as a character
        self.first = [np.flatnonzero(new[:, d]) for d in range(width + 1)]
        self.width, self.lattice, self.words = width, lattice, [words[i] for i in order]

    def terminal_counts(self) -> np.ndarray:
        """Pieces on the best path of each word, in the order given. Scores are computed once per node, not per word."""
        lattice, depth_counts = self.lattice, np.zeros(len(self.words), np.int64)
        hashes, best, count = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        live = [np.zeros(1, np.int64)]
        for depth in range(1, self.width + 1):
            first = self.first[depth]
            first = first[self.size[first] >= depth]  # below a word's end there is only padding
            own = self.code[first, depth - 1]
            level = np.full(len(self.first[depth]), -1, np.int64)
            level[self.node[first, depth]] = np.arange(len(first))
            live.append(level)
            up = live[depth - 1][self.node[first, depth - 1]]
            h = hashes[depth - 1][up] * _RADIX + own
            score, n = np.full(len(first), LOW, np.int64), np.zeros(len(first), np.int64)
            for length in range(min(depth, lattice.longest), 0, -1):
                at = live[depth - length][self.node[first, depth - length]]
                ids = lattice.find(h - hashes[depth - length][at] * lattice.power[length])
                weight = np.where(ids >= 0, lattice.weight[ids], UNKNOWN if length == 1 else LOW)
                value = np.where(weight > LOW // 2, best[depth - length][at] + weight, LOW)
                better = value > score
                score[better] = value[better]
                pieces = np.where(ids >= 0, 1, _utf8_length(own)) if length == 1 else 1
                n = np.where(better, count[depth - length][at] + pieces, n)
            hashes.append(h)
            best.append(score)
            count.append(n)
            ends = np.flatnonzero(self.size == depth)
            depth_counts[ends] = n[level[self.node[ends, depth]]]
        out = np.empty(len(self.words), np.int64)
        out[self.order] = depth_counts
        return out


def _utf8_length(code: np.ndarray) -> np.ndarray:
    c = code - np.uint64(1)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


class Counter:
    """Texts -> numbers of tokens, remembering the terminal counts of pre-tokens."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.known = lattice, {}

    def _learn(self, words: list[str]) -> None:
        """Insert new pre-tokens in tries of bounded tables; words of like length share one."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG_WORD:
                self.known[w] = len(self.lattice.path(w)) // 4
            else:
                by_length.setdefault(min(len(w).bit_length(), 9) if len(w) > 15 else 0, []).append(w)
        for group in by_length.values():
            width = max(map(len, group))
            group.sort()  # neighbours share prefixes, also where one table does not hold them all
            most = max(1, CELLS // (width + 1))
            for at in range(0, len(group), most):
                part = group[at : at + most]
                self.known.update(zip(part, Trie(self.lattice, part).terminal_counts().tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            split = [pretokens(t) for t in texts[at:to]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(list({w for words in split for w in words} - self.known.keys()))
            out.extend(sum(map(self.known.__getitem__, words)) for words in split)
            at = to
        return out


def token_counts(docs: DataFrame, path: str = PATH, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column `out` more: how many pieces the best segmentation of the whole text has.

    It is the number of ids that `sentencepiece_scan.encode` gives, without making them. Null and empty
    texts have none; equal texts have equal counts.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(Lattice(sent.value))
        for texts in batches:
            yield pa.array(counter.count([t or "" for t in texts.to_pylist()]), pa.int64())

    return docs.withColumn(out, F.arrow_udf(run, "long", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")))
