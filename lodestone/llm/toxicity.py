"""Toxicity scores of text restored by a noisy-channel decoder (operator 3)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, small_batches
from lodestone.llm.quality import logistic, probability

#: Symbols of the character model: 0 for a word's end, 1 to 26 for a to z without accents, 27 for any other letter.
SYMBOLS, ORDER = 28, 4
#: Bounds of what the classifier is fitted on: labelled rows of each class, and bytes of a text used so.
TRAINING_ROWS, TRAINING_BYTES = 8000, 1 << 17
#: A feature must stand out in toxic rows by this log-likelihood ratio, and be this much likelier there.
LEAST_RATIO, LEAST_ODDS = 24.0, 50.0
#: Lengths of word starts that are features beside whole words.
STARTS = (4, 5, 6)
#: Distinct features that a task counts before it sends them on, and words that it remembers before it begins anew.
COUNTED = 250_000
REMEMBERED = 200_000

# Letters that stand behind digits and signs in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
#: Log-probabilities of the channel.
SWAPPED, DROPPED, REPEATED, TWICE, BROKEN, KEPT_SIGN = -1.2, -0.7, -0.3, -3.0, -2.5, -4.0

_SIGNS = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
#: Stretches whose lattice has more than one path: a sign next to a letter, a letter twice, a mark between letters.
_NOISY = re.compile(rf"[{_SIGNS}]{_LETTER}|{_LETTER}[{_SIGNS}]|({_LETTER})\1|{_LETTER}[^\w\s]+{_LETTER}")
_DOUBLED = re.compile(rf"({_LETTER})\1")
_DOUBLED_RUN = re.compile(r"(.)\1+")
_SIGNED = re.compile(rf"[{_SIGNS}]{_LETTER}|{_LETTER}[{_SIGNS}]|{_LETTER}[^\w\s]+{_LETTER}")
#: Marks that end a piece of a word, and lengths of a stretch that is remembered.
_ENDS, REMEMBERED_LENGTH = ".,;:?\"", 64
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_WORD = re.compile(rf"{_LETTER}+")


def _single(word: str) -> str:
    return _DOUBLED_RUN.sub(r"\1", word)


def _fold(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[0x250:0x2000] = table[0x2C00:0xFB00] = 27
    for cp in range(0x250):
        c = _fold(chr(cp).lower()[0])
        table[cp] = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
    return table


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _symbol_table(), np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in slices(batches):
        text = "\n".join(t or "" for t in batch.column(0).to_pylist())
        codes = table[np.frombuffer(("\n" * 3 + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one mark between words
        codes = np.concatenate([np.zeros(2, np.int32), codes])
        gram = ((codes[:-3] * SYMBOLS + codes[1:-2]) * SYMBOLS + codes[2:-1]) * SYMBOLS + codes[3:]
        counts += np.bincount(gram, minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after three others, from all whole texts; SYMBOLS ** ORDER numbers whatever the input.

    Tasks count n-grams and Spark sums them; at most SYMBOLS ** ORDER sums reach the driver.
    """
    counted = docs.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**ORDER)
    n[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = n.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
        back = np.tile(p.reshape(-1, SYMBOLS), (len(c) // len(p.reshape(-1, SYMBOLS)), 1))
        p = (c + 5 * back) / (c.sum(1, keepdims=True) + 5)
    return np.log(p).astype(np.float32).ravel()


class Restorer:
    """Viterbi decoder over the character lattice of a noisy word or of single letters with spaces between."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.ids: dict[str, int] = {}

    def _id(self, c: str) -> int:
        found = self.ids.get(c)
        if found is None:
            f = _fold(c)
            found = self.ids[c] = ord(f) - 96 if "a" <= f <= "z" else 27 if f.isalpha() else 0
        return found

    def _ways(self, c: str, again: float | None) -> list[tuple[str, int, float]]:
        """(written, symbol or -1 for none, log-probability) for one seen character; again: what it costs to be a repeat."""
        repeat = [] if again is None else [("", -1, again)]
        if c.isalpha():
            return [(c, self._id(c), 0.0), *repeat]
        ways = [(x, ord(x) - 96, SWAPPED) for x in LEET.get(c, "")]
        if ways:
            return [*ways, (" ", 0, KEPT_SIGN), *repeat]
        return [("", -1, DROPPED), (" ", 0, BROKEN)]

    def restore(self, seen: str) -> str:
        """The likeliest source of a lower-cased stretch; at most SYMBOLS ** 3 contexts are alive at a time."""
        model, span = self.model, SYMBOLS ** (ORDER - 1)
        alive: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        n = len(seen)
        for k, c in enumerate(seen + "\n"):
            again = None
            if k and k < n and c == seen[k - 1]:  # a letter twice may be meant so, three times is not
                again = REPEATED if (k > 1 and seen[k - 2] == c) or (k + 1 < n and seen[k + 1] == c) else TWICE
            ways = [(" ", 0, 0.0)] if c == "\n" else self._ways(c, again)
            after: dict[int, tuple[float, tuple]] = {}
            for context, (score, path) in alive.items():
                for written, symbol, cost in ways:
                    if symbol < 0:
                        to, s, q = context, score + cost, path
                    elif symbol == 0 and context % SYMBOLS == 0:
                        to, s, q = context, score + cost, path
                    else:
                        to, s, q = (context * SYMBOLS + symbol) % span, score + cost + model[context * SYMBOLS + symbol], (path, written)
                    if to not in after or s > after[to][0]:
                        after[to] = (s, q)
            alive = after
        path, out = max(alive.values(), key=lambda x: x[0])[1], []
        while path:
            path, written = path
            out.append(written)
        return "".join(reversed(out))


class Reader:
    """Whole text -> the features of its words, restored where noisy."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float] | None = None):
        self.restorer, self.lexicon = Restorer(model), lexicon
        self.known: dict[str, tuple] = {}
        self.whole = ahocorasick.Automaton()
        for w in lexicon or ():
            if not w.endswith("-"):
                self.whole.add_word(w, len(w))
        self.whole.make_automaton()
        # What the lexicon's words and starts are without repeats of letters.
        self.single = {_single(w.removesuffix("-")) for w in lexicon or ()}
        self.longest = max(map(len, self.single), default=0)

    def _of(self, seen: str) -> tuple:
        """Features of one stretch without spaces, or of spaced letters: those in the lexicon, or all without one."""
        found = set()
        plain = _WORD.findall(seen)
        restored = _WORD.findall(self.restorer.restore(seen)) if self._matters(seen, plain) else []
        for w in (*plain, *restored):
            for x in (w, *(w[:k] + "-" for k in STARTS if len(w) >= k)):
                if self.lexicon is None or x in self.lexicon:
                    found.add(x)
        return tuple(found)

    def _matters(self, seen: str, plain: list[str]) -> bool:
        """Whether a stretch has paths that can show something: where letters are only doubled, without repeats it begins as the lexicon's words do."""
        if " " in seen or _SIGNED.search(seen):
            return True
        if not _DOUBLED.search(seen):
            return False
        return self.lexicon is None or any(w[:k] in self.single for w in map(_single, plain) for k in range(1, min(len(w), self.longest) + 1))

    def features(self, text: str) -> set[str]:
        text = text.lower()
        known, out = self.known, set()
        if len(known) > REMEMBERED:
            known.clear()
        stretches = set(text.split())
        stretches.update(re.sub(r"\s+", " ", m) for m in _SPACED.findall(text))
        if len(self.whole):
            stretches.update(self._pieces(text))
        for seen in stretches:
            found = known.get(seen)
            if found is None:
                found = self._of(seen)
                if len(seen) <= REMEMBERED_LENGTH:
                    known[seen] = found
            if found:
                out.update(found)
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        """Neighbouring words that are a word of the lexicon without the blanks between them."""
        for mark in _ENDS:
            text = text.replace(mark, "")
        words = text.split()
        hits = [(end + 1 - n, end + 1) for end, n in self.whole.iter("".join(words))]
        if hits:
            edges = {0: 0}
            edges.update((at, k) for k, at in enumerate(accumulate(map(len, words)), 1))
            for a, b in hits:
                if a in edges and b in edges and edges[b] - edges[a] > 1:
                    yield " ".join(words[edges[a] : edges[b]])


@dataclass(frozen=True)
class ToxicityModel:
    """Character model, log-odds of the features that tell toxic rows, and the weights of the calibration."""

    characters: np.ndarray
    lexicon: dict[str, float]
    weights: tuple[float, ...]


def _inputs(found: list[float]) -> tuple[float, float]:
    return max(found, default=0.0), math.log1p(len(found))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Fit on all texts (character model) and on a bounded sample of labelled rows (lexicon, calibration).

    Features are words and word starts of the restored text. Each is counted once a row; those that stand
    out in toxic rows make the lexicon. Without rows of either class the lexicon is empty and every score
    is the share of label 1 (a half without any label).
    """
    spark = docs.sparkSession
    small_batches(spark)
    characters = character_model(docs)
    kept = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("toxic"))
    share = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    chosen = [kept.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS) for v in (1, 0)]
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAINING_BYTES).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sent = spark.sparkContext.broadcast(characters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(sent.value), (Counter(), Counter())
        total = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                total[toxic] += 1
                seen[toxic].update(reader.features(text or ""))
            if len(seen[0]) > COUNTED:  # sent on in parts, which Spark sums
                yield _counted(seen)
                seen = (Counter(), Counter())
        seen[0][""], seen[1][""] = total
        yield _counted(seen)

    counts = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    counts.persist()
    none = counts.filter("feature = ''").first()
    nt, nc = (int(none.a), int(none.b)) if none else (0, 0)
    if not nt or not nc:
        p = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
        counts.unpersist()
        return ToxicityModel(characters, {}, (math.log(p / (1 - p)), 0.0, 0.0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    expected = (a + b) / (nt + nc)
    ratio = 2 * (a * F.log(a / (expected * nt)) + F.when(b > 0, b * F.log(b / (expected * nc))).otherwise(0.0))
    odds = ((a + 0.1) / (nt + 0.2)) / ((b + 0.1) / (nc + 0.2))
    least = min(LEAST_RATIO, max(8.0, 0.4 * nt))
    lexicon = {r.feature: float(r.w) for r in counts.filter((F.col("a") > 1) & (F.col("feature") != "")).withColumn("ratio", ratio).withColumn("odds", odds).filter((F.col("ratio") >= least) & (F.col("odds") >= LEAST_ODDS)).select("feature", F.log("odds").alias("w")).collect()}
    counts.unpersist()
    words = spark.sparkContext.broadcast(lexicon)

    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value, words.value)
        for batch in batches:
            x = [_inputs([words.value[f] for f in reader.features(t or "")]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column("toxic").cast(pa.float64())], ["x1", "x2", "y"])

    fitted = rows.mapInArrow(fit_rows, "x1 double, x2 double, y double").toArrow()  # two rows of numbers for each training row
    x = np.column_stack([fitted.column(c).to_numpy() for c in ("x1", "x2")])
    y = fitted.column("y").to_numpy()
    w = list(logistic(x, y, ridge=0.1))
    w[0] += math.log(share[1] / share[0]) - math.log(nt / nc)
    return ToxicityModel(characters, lexicon, tuple(w))


def _counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    keys = list(seen[0] | seen[1])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())], ["feature", "clean", "toxic"])


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity_score") -> DataFrame:
    """docs with a column `out` more: how likely label 1 is for the whole text, 0 to 1.

    Noisy stretches are restored first; stretches whose lattice has one path stay as they are. Null and
    empty texts have no features and get the score of clean text; equal texts get equal scores.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        reader = Reader(held.characters, held.lexicon)
        for texts in batches:
            x = np.array([_inputs([held.lexicon[f] for f in reader.features(t.as_py() or "")]) for t in texts], float).reshape(-1, 2)
            yield pa.array(probability(x, held.weights), pa.float64())

    return docs.withColumn(out, F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")))


def restore(docs: DataFrame, characters: np.ndarray, text_col: str = "text", out: str = "restored") -> DataFrame:
    """docs with a column `out` more: the text with each noisy stretch replaced by its restored form (null stays null)."""
    sent = docs.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(sent.value)
        for texts in batches:
            yield pa.array([None if (t := x.as_py()) is None else restored_text(t, restorer) for x in texts], pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")))


def restored_text(text: str, restorer: Restorer) -> str:
    joined = _SPACED.sub(lambda m: restorer.restore(m[0].lower()).strip(), text)
    return re.sub(r"\S+", lambda m: restorer.restore(m[0].lower()).strip() if _NOISY.search(m[0].lower()) else m[0], joined)
