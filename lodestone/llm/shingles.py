"""Words and word shingles of whole batches of text as 64-bit numbers, computed on their bytes with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random-looking number for each byte, so that sums over words do not collide by structure.
_BYTES = None


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of bytes other than white space, A-Z lower-cased) and the words' count of each text.

    flat: bytes of the texts end to end; ends: their offsets, one more than texts.
    """
    global _BYTES
    if _BYTES is None:
        _BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
    texts = len(ends) - 1
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    inside = ~_SPACE[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    for edge in ends[1:-1]:  # a word does not go on into the next text
        if 0 < edge < len(flat) and inside[edge] and inside[edge - 1]:
            starts[edge] = stops[edge - 1] = True
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    power, back = _powers(_RADIX, len(flat)), _powers(_INVERSE, len(flat))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[_LOWER[flat]] * power, dtype=np.uint64)])
    # The sum over a word, moved back to exponent 0 so that its place does not matter.
    value = (total[last + 1] - total[first]) * back[first]
    value = mixed(value ^ ((last - first + 1).astype(np.uint64) << np.uint64(48)))
    counts = np.searchsorted(first, ends[1:]) - np.searchsorted(first, ends[:-1])
    return value, counts


def shingle_sets(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of each text: runs of SHINGLE words, or all words of a shorter text; none without words."""
    words, counts = word_hashes(flat, ends)
    at, out = 0, []
    if len(words) >= SHINGLE:
        runs = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            runs = mixed(runs * np.uint64(31) + words[k : len(words) - SHINGLE + 1 + k] + np.uint64(k + 1))
    for n in counts:
        if n >= SHINGLE:
            out.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one = mixed(one * np.uint64(31) + words[at + k] + np.uint64(k + 1))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
