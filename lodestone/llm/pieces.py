"""A SentencePiece vocabulary as a lattice of pieces: normalisation, lookup of substrings, best paths of words.

Pieces are weighed by the scores in the model file and a text's encoding is the path of the greatest sum
(SentencePiece's unigram decoding). Scores are whole numbers here, so sums are exact at any length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Weights are scores times 2 ** SHIFT; the low bits tell apart paths of equal score, alike wherever a path is met.
SHIFT = 20
#: Scores below this count as this: such pieces (runs of marks) still lose to any others that cover the same text.
FLOOR = -(1 << 26)
#: A character in no piece is spelled in bytes. No path avoids it, so its weight decides nothing.
UNKNOWN = -(1 << 37)
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
LOW = -(1 << 61)
#: Words longer than this, or fewer of a length than this, are done one at a time.
LONG_WORD, FEW = 512, 6
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and the ids of the 256 byte pieces; small (tens of thousands of strings), so it is broadcast."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    bytes_at: tuple[int, ...]

    @staticmethod
    def load(path: str = PATH) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = tuple(model.id_to_piece(i) for i in range(n))
        usable = tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n))
        at = {p: i for i, p in enumerate(pieces) if model.is_byte(i)}
        return Vocabulary(pieces, tuple(model.get_score(i) for i in range(n)), usable, tuple(at[f"<0x{b:02X}>"] for b in range(256)))


class Lattice:
    """Lookup of substrings by rolling hashes, for many words at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ids = [i for i, ok in enumerate(vocabulary.usable) if ok]
        self.longest = max(len(vocabulary.pieces[i]) for i in ids)
        self.weight = np.zeros(len(vocabulary.pieces) + 1, np.int64)
        self.length = np.zeros(len(vocabulary.pieces) + 1, np.int64)
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _RADIX, np.uint64)]))
        hashes = np.zeros(len(ids), np.uint64)
        for k, i in enumerate(ids):
            p = vocabulary.pieces[i]
            self.weight[i] = (max(round(vocabulary.scores[i]), FLOOR) << SHIFT) + (i * 2654435761 & 0x3FFF)
            self.length[i] = len(p)
            h = np.uint64(0)
            for c in p:
                with np.errstate(over="ignore"):
                    h = h * _RADIX + np.uint64(ord(c) + 1)
            hashes[k] = h
        for b, i in enumerate(vocabulary.bytes_at):  # one of a character's bytes stands for it
            self.weight[i] = 0 if 0x80 <= b < 0xC0 else UNKNOWN
        # Open addressing: a table of hashes and ids with room enough that few steps are needed.
        self.bits = 18
        self.table, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for h, i in zip(hashes, ids, strict=True):
            slot = int(self._slots(np.array([h], np.uint64))[0])
            while self.ids[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table[slot], self.ids[slot] = h, i
        runs = np.flatnonzero(np.concatenate([self.ids, self.ids[:64]]) < 0)
        self.steps = int(np.diff(runs, prepend=-1).max())

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids by hash, -1 where there is none."""
        slot = self._slots(hashes)
        ids = self.ids[slot]
        hit = self.table[slot] == hashes
        out = np.where(hit, ids, np.int32(-1))
        left = np.flatnonzero(~hit & (ids >= 0))
        for _ in range(self.steps):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            ids = self.ids[slot[left]]
            hit = self.table[slot[left]] == hashes[left]
            out[left[hit]] = ids[hit]
            left = left[~hit & (ids >= 0)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The best path of each word as packed little-endian 32-bit ids.

        Words of like length are done in step, the more alike the shorter they are; a few long ones one at a time. Both
        ways take the shortest last piece of equally good ones, so that they agree.
        """
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            by_length.setdefault(n + 3 >> 2 if n <= 16 else 100 + n.bit_length() * 4 + (n >> n.bit_length() - 3), []).append(k)
        for group in by_length.values():
            if len(group) < FEW or len(words[group[0]]) > LONG_WORD:
                for k in group:
                    out[k] = self.path(words[k])
                continue
            width = max(len(words[k]) for k in group)
            most = max(1, (1 << 20) // (width + 1))
            for at in range(0, len(group), most):
                part = group[at : at + most]
                for k, ids in zip(part, self._paths([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def found(self, text: str) -> np.ndarray:
        """Piece ids of all substrings: row k - 1, place p is that of the k characters that end before place p."""
        n = len(text)
        code = self.codes([text], n)[0] if n else np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        # Prefix sums of code * radix ** -place, so that all are had at once; a substring's hash is moved back.
        inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
        scale = np.full(n + 1, inverse, np.uint64)
        scale[0] = 1
        scale = np.multiply.accumulate(scale)
        up = np.full(n + 1, _RADIX, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        np.cumsum(code * scale[:n], out=total[1:])
        out = np.full((self.longest, n + 1), -1, np.int32)
        for k in range(1, min(self.longest, n) + 1):
            ends = np.arange(k, n + 1)
            out[k - 1, k:] = self.find((total[ends] - total[ends - k]) * up[ends - 1])
        return out

    def transfers(self, text: str, entries: list[int], stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores of paths over text whose last piece starts before `stop`.

        Returns for each place and each entry (a place where the path begins): the score, LOW where none
        leads, and, common to all entries of one, the id and length of the last piece (first entry's).
        """
        n, ids = len(text), self.found(text)
        weights = np.where(ids >= 0, self.weight[ids], LOW)
        weights[0] = np.where(ids[0] >= 0, weights[0], UNKNOWN)
        width = len(entries)
        best = np.full((n + 1, width), LOW, np.int64)
        last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        for k, e in enumerate(entries):
            if e <= n:
                best[e, k] = 0
        for end in range(1, n + 1):
            first = max(0, end - self.longest, min(end, 0))
            starts = np.arange(min(end, stop) - 1, first - 1, -1)
            if not len(starts):
                continue
            steps = end - starts
            score = best[starts] + weights[steps - 1, end][:, None]
            score[best[starts] <= LOW // 2] = LOW
            score[weights[steps - 1, end] <= LOW // 2] = LOW
            top = score.argmax(0)
            value = score[top, np.arange(width)]
            better = value > best[end]
            if better.any():
                best[end][better] = value[better]
                if better[0]:
                    last[end], back[end] = ids[steps[top[0]] - 1, end], steps[top[0]]
        return best, last, back

    def path(self, text: str, entry: int = 0, leave: int | None = None, stop: int | None = None) -> bytes:
        """The best path of one stretch from place `entry` to `leave`; the last piece starts before `stop`."""
        leave = len(text) if leave is None else leave
        _, last, back = self.transfers(text, [entry], leave if stop is None else stop)
        at, places, ids = leave, [], []
        while at > entry:
            places.append(at)
            ids.append(last[at])
            at -= back[at]
        return self.with_bytes(text, np.array(places[::-1], np.int64), np.array(ids[::-1], np.int64))

    def score(self, packed: bytes) -> int:
        return int(self.weight[np.frombuffer(packed, "<i4")].sum())

    def codes(self, words: list[str], width: int) -> np.ndarray:
        """Code points plus one, padded with 0, a column for each place."""
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
        return flat.astype(np.uint64) + np.uint64(1)

    def _paths(self, words: list[str], width: int) -> list[bytes]:
        n = len(words)
        size = np.array([len(w) for w in words])
        code = self.codes(words, width)
        total = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            total[i + 1] = total[i] * _RADIX + code[:, i]
        best = np.full((width + 1, n), LOW, np.int64)
        best[0] = 0
        piece = np.full((width + 1, n), -1, np.int32)
        back = np.ones((width + 1, n), np.int16)
        for end in range(1, width + 1):
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                ids = self.find(total[end] - total[start] * self.power[length])
                w = self.weight[ids] if length > 1 else np.where(ids >= 0, self.weight[ids], UNKNOWN)
                score = best[start] + w
                better = (score > best[end]) & ((ids >= 0) | (length == 1))
                best[end][better] = score[better]
                piece[end][better] = ids[better]
                back[end][better] = length
        return self._spelled(words, size, piece, back)

    def _spelled(self, words: list[str], size: np.ndarray, piece: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Follow all words' paths back at once, then spell unknown characters in bytes."""
        n = len(words)
        at, rows, places, found = size.copy(), [], [], []
        who = np.flatnonzero(at > 0)
        while len(who):
            ids = piece[at[who], who]
            rows.append(who)
            places.append(at[who])
            found.append(ids)
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        if not rows:
            return [b""] * n
        rows_, places_, found_ = np.concatenate(rows), np.concatenate(places), np.concatenate(found)
        order = np.lexsort((places_, rows_))
        rows_, places_, found_ = rows_[order], places_[order], found_[order]
        ends = np.searchsorted(rows_, np.arange(n + 1))
        unknown = np.zeros(n, bool)
        unknown[rows_[found_ < 0]] = True
        packed = found_.astype("<i4").tobytes()
        return [self.with_bytes(words[k], places_[ends[k] : ends[k + 1]], found_[ends[k] : ends[k + 1]]) if unknown[k] else packed[4 * ends[k] : 4 * ends[k + 1]] for k in range(n)]

    def with_bytes(self, text: str, places: np.ndarray, ids: np.ndarray) -> bytes:
        """Packed ids where -1 stands for the character that ends at that place, spelled in byte pieces."""
        out: list[int] = []
        for place, i in zip(places.tolist(), ids.tolist(), strict=True):
            out.extend([i] if i >= 0 else (self.vocabulary.bytes_at[b] for b in text[place - 1].encode("utf-8", "surrogatepass")))
        return np.array(out, "<i4").tobytes()


def normalised(text: str) -> str:
    """A mark in front and in place of every blank, as the model's identity normaliser does; nothing for empty text."""
    return MARK + text.replace(" ", MARK) if text else ""


class Decoder:
    """Ids -> text: pieces joined, byte pieces gathered to characters, marks back to blanks, the first one taken off."""

    def __init__(self, vocabulary: Vocabulary):
        spelled = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_at)}
        self.bytes_of = [spelled[i] if i in spelled else p.replace(MARK, " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable, strict=True))]
        self.sizes = np.array([len(b) for b in self.bytes_of])

    def decode(self, packed: bytes) -> str:
        text = self.spelled(packed).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text

    def lost(self, words: list[str], packed: list[bytes]) -> list[str]:
        """Words that their ids do not decode to: none if all have their lengths and agree end to end, else one by one."""
        seen = [w.replace(MARK, " ").encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(p) // 4 for p in packed])
        flat = b"".join(packed)
        total = np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(flat, "<i4")])])
        if (total[ends] == np.cumsum([len(s) for s in seen])).all() and self.spelled(flat) == b"".join(seen):
            return []
        return [w for w, s, p in zip(words, seen, packed, strict=True) if self.spelled(p) != s]

    def spelled(self, packed: bytes) -> bytes:
        """The bytes that ids stand for, with the blank in front."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<i4").tolist()))


def pretokens(text: str) -> list[str]:
    """Stretches that no piece crosses, in order: marks and the characters up to the next mark."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return _STRETCH.findall(normalised(text))
    return (MARK + text.replace(" ", f" {MARK}")).split(" ")
