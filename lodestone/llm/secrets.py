"""Secret scans by probabilistic automata inferred from labelled credentials (operator 7)."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, small_batches

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex")
#: The same findings, written so that a run too short to count is not tried at every place in it.
_ACCESS, _HEX = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"), re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}")
#: What the automata score: every run of credential characters as long as the least credential, with its padding.
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.-]{{{ASSIGN_VALUE},}}={{0,2}}")
#: The bounded sample of labelled credentials that automata are inferred from: distinct values of a kind, and symbols of one
#: (a longer one is learned from as far as that, and scored whole).
SAMPLE_VALUES, SAMPLE_SYMBOLS = 2000, 512
#: Merge test: chance of refusing to merge equal states, and visits below which a state tells too little to go into another depth.
ALPHA, LEAST_VISITS = 0.1, 16
#: Weight of each symbol that a state has not seen.
UNSEEN = 0.2
#: A candidate is a secret when a format is likelier than plain symbols by so many nats, and when of what ends in the same state
#: of the format and is mixed like it, over the whole corpus, at least this share is labelled. Mixed values that a
#: state has are of one random format, so bare ones do not count against it: so many labelled ones are enough.
MARGIN, SHARE, LABELLED = 12.0, 0.1, 5
#: Changes between digits, small and capital letters (but for a capital before a small letter) from which a value is mixed.
MIXED = 5
#: Chance that a run of one symbol goes on, in plain symbols.
RUNS = 0.8
#: Values that a task remembers before it begins anew.
REMEMBERED = 200_000
#: Characters of texts whose values are scored together.
AT_ONCE = 1 << 20

#: What the automata read: digits, hex letters and other letters in either case, the marks, and the end.
SYMBOLS, END = 12, 11
_TABLE = bytearray([10]) * 256
for _chars, _symbol in ((b"0123456789", 0), (b"abcdef", 1), (b"ghijklmnopqrstuvwxyz", 2), (b"ABCDEF", 3), (b"GHIJKLMNOPQRSTUVWXYZ", 4), (b"+", 5), (b"/", 6), (b"_", 7), (b".", 8), (b"=", 9), (b"-", 10)):
    for _c in _chars:
        _TABLE[_c] = _symbol
_TABLE = bytes(_TABLE)


def symbols(value: str) -> bytes:
    """One symbol for each character of an ASCII value."""
    return value.encode("ascii", "replace").translate(_TABLE)


def base_spans(text: str, runs: list[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' findings, in code points, by start and then kind as listed.

    Patterns are tried only on texts that have what they need: a word, a prefix, a long enough run (`runs`: those of the text).
    """
    low, out = text.lower(), []
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    if max(map(len, _CANDIDATE.findall(text) if runs is None else runs), default=0) >= HEX_LENGTH:
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def labelled(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, str]]:
    """(kind, value) of the credentials in base spans; of an assignment its right side."""
    for a, b, kind in spans:
        yield kind, ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b]


class Automaton:
    """A probabilistic automaton: visits and ends by state, counts and targets of its transitions."""

    def __init__(self) -> None:
        self.visits, self.ends, self.depth, self.moves = [0], [0], [0], [{}]  # moves: symbol -> [target, count]
        self.same: dict[int, int] = {}  # a merged state -> the one that it went into

    def prefix_tree(self, words: Counter[bytes]) -> Automaton:
        """The prefix tree of symbol strings; of a longer one than SAMPLE_SYMBOLS its beginning, without an end."""
        for word, n in sorted(words.items()):
            at = 0
            self.visits[0] += n
            for c in word[:SAMPLE_SYMBOLS]:
                move = self.moves[at].get(c)
                if move is None:
                    self.visits.append(0)
                    self.ends.append(0)
                    self.depth.append(self.depth[at] + 1)
                    self.moves.append({})
                    move = self.moves[at][c] = [len(self.visits) - 1, 0]
                move[1] += n
                at = move[0]
                self.visits[at] += n
            if len(word) <= SAMPLE_SYMBOLS:
                self.ends[at] += n
        return self

    def find(self, state: int) -> int:
        """The state that a state is now part of."""
        while state in self.same:
            state = self.same[state]
        return state

    def _alike(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < (1 / math.sqrt(n1) + 1 / math.sqrt(n2)) * math.sqrt(0.5 * math.log(2 / ALPHA))

    def compatible(self, p: int, q: int) -> bool:
        """Whether two states end and go on alike (Hoeffding's bound), and so do the states after them."""
        todo, met = [(p, q)], set()
        while todo:
            p, q = map(self.find, todo.pop())
            if p == q or (p, q) in met or not self.visits[p] or not self.visits[q]:
                continue
            met.add((p, q))
            if not self._alike(self.ends[p], self.visits[p], self.ends[q], self.visits[q]):
                return False
            for c in self.moves[p].keys() | self.moves[q].keys():
                a, b = self.moves[p].get(c), self.moves[q].get(c)
                if not self._alike(a[1] if a else 0, self.visits[p], b[1] if b else 0, self.visits[q]):
                    return False
                if a and b and min(self.visits[self.find(a[0])], self.visits[self.find(b[0])]) >= LEAST_VISITS:
                    todo.append((a[0], b[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Make two states one, and so those that equal symbols lead to from them. Every fold leaves a state less."""
        todo = [(p, q)]
        while todo:
            p, q = sorted(map(self.find, todo.pop()), key=lambda x: (self.depth[x], x))
            if p == q:
                continue
            self.same[q] = p
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, (target, n) in self.moves[q].items():
                own = self.moves[p].get(c)
                if own is None:
                    self.moves[p][c] = [target, n]
                else:
                    own[1] += n
                    todo.append((own[0], target))

    def merged(self) -> Automaton:
        """Merge compatible states, first within each depth, then with states nearer the root; what lies below folds in.

        Random symbols make a bushy tree in which no state has the visits to show how long words are. Merged by
        depth, a format of fixed length is a chain whose states have them all, so that it stays one, while words
        of any length then fold into loops.
        """
        self._merge(self._of_own_depth)
        self._merge(self._nearer)
        return self

    def _merge(self, choose) -> None:
        """From the root on and depth by depth, by visits: a state goes into the one that `choose` names, else it stays."""
        red = {0}
        while True:
            red = {self.find(r) for r in red}
            fringe = {self.find(t) for p in red for t, _ in self.moves[p].values()} - red
            if not fringe:
                return
            depth = min(self.depth[b] for b in fringe)
            for blue in sorted((b for b in fringe if self.depth[b] == depth), key=lambda b: (-self.visits[b], b)):
                if blue in self.same:
                    continue
                held = sorted({self.find(r) for r in red}, key=lambda r: (self.depth[r], r))
                into = choose(blue, [r for r in held if self.depth[r] == depth], [r for r in held if self.depth[r] < depth])
                if into is None:
                    red.add(blue)
                else:
                    self._fold(into, blue)

    def _of_own_depth(self, blue: int, own: list[int], nearer: list[int]) -> int | None:
        """A compatible state of the same depth; for a rare state that nothing fits, the likest of its depth."""
        fit = next((r for r in own if self.compatible(r, blue)), None)
        if fit is None and self.visits[blue] < LEAST_VISITS:
            return max(own, key=lambda r: (self._likeness(r, blue), self.visits[r]), default=None)
        return fit

    def _nearer(self, blue: int, own: list[int], nearer: list[int]) -> int | None:
        """A compatible state nearer the root, where both have visits enough to tell. Words' last states stay apart."""
        if self.visits[blue] < LEAST_VISITS or not self.moves[blue]:
            return None
        return next((r for r in nearer if self.moves[r] and self.visits[r] >= LEAST_VISITS and self.compatible(r, blue)), None)

    def _likeness(self, p: int, q: int) -> float:
        """How much of q's next symbols (and end) p has too, by share."""
        n = max(1, self.visits[p])
        same = sum(k * self.moves[p][c][1] for c, (_, k) in self.moves[q].items() if c in self.moves[p])
        return (same + self.ends[q] * self.ends[p]) / n

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Targets and log-probabilities by state and symbol, of the states that the root leads to.

        A symbol that a state has not seen leads where most of its words go (a leaf stays where it is).
        """
        index, todo = {0: 0}, [0]
        for p in todo:
            for c in sorted(self.moves[p]):
                target = self.find(self.moves[p][c][0])
                if target not in index:
                    index[target] = len(index)
                    todo.append(target)
        to, logp = np.zeros((len(index), SYMBOLS), np.int32), np.zeros((len(index), SYMBOLS))
        for p, row in index.items():
            main = self.find(max(self.moves[p].items(), key=lambda m: (m[1][1], -m[0]))[1][0]) if self.moves[p] else p
            to[row] = index[main]
            counts = np.full(SYMBOLS, UNSEEN)
            for c, (target, n) in self.moves[p].items():
                to[row, c] = index[self.find(target)]
                counts[c] += n
            counts[END] += self.ends[p]
            logp[row] = np.log(counts / counts.sum())
        return to, logp


@dataclass(frozen=True)
class Formats:
    """The automata of all kinds, end to end in one table: kinds, their first states, targets, log-probabilities."""

    kinds: tuple[str, ...]
    starts: tuple[int, ...]
    to: np.ndarray
    logp: np.ndarray

    @staticmethod
    def of(automata: dict[str, Automaton]) -> Formats:
        kinds, starts, to, logp, at = tuple(automata), [], [np.zeros((0, SYMBOLS), np.int32)], [np.zeros((0, SYMBOLS))], 0
        for a in automata.values():
            t, p = a.tables()
            starts.append(at)
            to.append(t + at)
            logp.append(p)
            at += len(t)
        return Formats(kinds, tuple(starts), np.concatenate(to), np.concatenate(logp))

    def read(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each value: the state in which its likeliest format ends it, and how much likelier that is than plain symbols.

        Plain symbols are all alike, or runs of one (the likelier of both counts): long numbers and repeated letters are
        plain. Values of like length go through the tables in step.
        """
        state, margin = np.full(len(values), -1, np.int64), np.full(len(values), -math.inf)
        if not self.kinds:
            return state, margin
        size = np.array([len(v) for v in values], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * size[order[stop]] <= 1 << 18:
                stop += 1
            part = order[at:stop]
            sizes, width = size[part], int(size[part[-1]])
            codes = np.frombuffer(b"".join(symbols(values[k]).ljust(width, bytes([SYMBOLS])) for k in part), np.uint8).reshape(len(part), width).T
            here = np.repeat(np.array(self.starts, np.int64)[:, None], len(part), 1)
            total = np.zeros(here.shape)
            first = np.searchsorted(sizes, np.arange(width), side="right")
            for p in range(width):
                live, c = slice(int(first[p]), None), codes[p, int(first[p]) :]
                s = here[:, live]
                total[:, live] += self.logp[s, c]
                here[:, live] = self.to[s, c]
            total += self.logp[here, END]
            best = total.argmax(0)
            state[part] = here[best, np.arange(len(part))]
            again = ((codes[1:] == codes[:-1]) & (codes[1:] < SYMBOLS)).sum(0)
            runs = again * math.log(RUNS + (1 - RUNS) / SYMBOLS) + (sizes - again) * math.log((1 - RUNS) / SYMBOLS)
            margin[part] = total[best, np.arange(len(part))] + math.log(SYMBOLS) - np.maximum(runs, -math.log(SYMBOLS) * sizes)
            at = stop
        return state, margin

    def kind(self, state: int) -> str:
        return self.kinds[bisect.bisect_right(self.starts, state) - 1]


@dataclass(frozen=True)
class SecretModel:
    """The inferred formats, and the cells that labelled credentials take their due share of, with that share."""

    formats: Formats
    secret: dict[int, float]


def _bare(run: str) -> str:
    """A run without the full stops around it."""
    return run.strip(".")


_CHANGE = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])")


def cell(value: str, state: int) -> int:
    """What values are counted and told by: the state that ends them, and whether they are mixed as no word or number is."""
    return 2 * state + (sum(1 for _ in _CHANGE.finditer(value)) >= MIXED)


class Reader:
    """Scores each run once and remembers it."""

    def __init__(self, formats: Formats, secret: dict[int, float] | None = None):
        self.formats, self.secret, self.known = formats, secret or {}, {}
        self.found: set[str] = set()  # remembered runs of a secret format

    def read(self, runs: set[str]) -> dict[str, int]:
        """The end state of each run that a format explains, -1 for others; at least for the given ones."""
        known = self.known
        new = list(runs - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            self.found.clear()
            new = list(runs)
        values = [_bare(v) for v in new]
        fit = [k for k, v in enumerate(values) if len(v) >= ASSIGN_VALUE]
        state, margin = self.formats.read([values[k] for k in fit])
        known.update(dict.fromkeys(new, -1))
        for k, s, m in zip(fit, state.tolist(), margin.tolist(), strict=True):
            if m >= MARGIN:
                known[new[k]] = s
                if self.secret and cell(values[k], s) in self.secret:
                    self.found.add(new[k])
        return known


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Places of the values to be scored: runs without the full stops around them, away from base spans."""
    cover: list[list[int]] = []
    for a, b, _ in spans:
        if cover and a < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    stops = [b for _, b in cover]
    for m in _CANDIDATE.finditer(text):
        value = _bare(m[0])
        a = m.start() + m[0].find(value)
        b = a + len(value)
        k = bisect.bisect_right(stops, a)
        if len(value) >= ASSIGN_VALUE and not (k < len(cover) and cover[k][0] < b):
            yield a, b


def learn(docs: DataFrame, text_col: str = "text") -> SecretModel:
    """Automata from the credentials that the base patterns label, and what else in the corpus has their formats.

    Automata are inferred on the driver from SAMPLE_VALUES distinct labelled values of a kind, chosen by hash. Every
    labelled value and every other candidate of all texts is then read by them, and Spark counts both by the state that
    ends them and whether they are mixed; such a cell is a secret format when labelled values are at least SHARE of it, or
    LABELLED of them where it is of mixed values. There are two counts for each state, whatever the number of texts. Without labelled values there are no formats and nothing is added.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(kind, value) for text in batch.column(0).to_pylist() for kind, value in labelled(text or "", base_spans(text or ""))}
            rows = [(kind, symbols(v)[: SAMPLE_SYMBOLS + 1], hashlib.blake2b(v.encode(), digest_size=16).digest()) for kind, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["kind", "word", "value"])

    values = texts.mapInArrow(label, "kind string, word binary, value binary").dropDuplicates(["kind", "value"])
    values.persist()
    automata = {}
    for kind in KINDS:
        rows = values.filter(F.col("kind") == kind).orderBy("value", "word").limit(SAMPLE_VALUES).coalesce(1).collect()
        if rows:
            automata[kind] = Automaton().prefix_tree(Counter(bytes(r.word) for r in rows)).merged()
    values.unpersist()
    formats = Formats.of(automata)
    if not formats.kinds:
        return SecretModel(formats, {})
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # at most SAMPLE_VALUES * SAMPLE_SYMBOLS states of a kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        taken = np.zeros((2 * len(sent.value.to), 2), np.int64)
        for batch in slices(batches):
            seen = (Counter(), Counter())
            for text in batch.column(0).to_pylist():
                runs = _CANDIDATE.findall(text or "")
                spans = base_spans(text or "", runs)
                seen[0].update((text[a:b] for a, b in candidates(text, spans)) if spans else runs)
                seen[1].update(v for _, v in labelled(text or "", spans))
            for side, n in enumerate(seen):
                known = reader.read(n.keys() | set())
                for v, k in n.items():
                    s = known[v]
                    if s >= 0:
                        taken[cell(_bare(v), s), side] += k
        some = np.flatnonzero(taken.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(taken[some, 0]), pa.array(taken[some, 1])], ["state", "other", "labelled"])

    counts = texts.mapInArrow(count, "state long, other long, labelled long").groupBy("state").agg(F.sum("other").alias("o"), F.sum("labelled").alias("l"))
    share = F.col("l") / (F.col("l") + F.col("o"))
    due = (share >= SHARE) | ((F.col("state") % 2 == 1) & (F.col("l") >= LABELLED))
    return SecretModel(formats, {r.state: r.share for r in counts.filter(due).select("state", share.alias("share")).collect()})


def spans_of(text: str, runs: list[str], model: SecretModel, reader: Reader) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and candidates of a secret format, as kind 'likely-<kind>'.

    runs: those of the text, which the reader has read.
    """
    base = base_spans(text, runs)
    if not model.secret or reader.found.isdisjoint(runs):
        return base, base
    known, more = reader.read({text[a:b] for a, b in candidates(text, base)}), []
    for a, b in candidates(text, base):
        s = known[text[a:b]]
        if s >= 0 and cell(text[a:b], s) in model.secret:
            more.append((a, b, f"likely-{model.formats.kind(s)}"))
    order = {k: i for i, k in enumerate((*KINDS, *(f"likely-{k}" for k in KINDS)))}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_FOUND = "struct<base:string,spans:string,n_assign:bigint,n_access:bigint,n_hex:bigint>"
_ARROW = pa.struct([("base", pa.string()), ("spans", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64())])


def secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a struct column `out` more: base and all spans as text (kind:start:end, comma-joined), and base counts by kind.

    Null and empty texts have none. Places are code points of the whole text, ends exclusive. Equal texts
    get equal spans. Spans of the method never overlap a base span.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE_VALUES * SAMPLE_SYMBOLS states of each kind

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        reader = Reader(held.formats, held.secret)
        for batch in batches:
            rows, texts, at = [], [t or "" for t in batch.to_pylist()], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                    size += len(texts[to])
                    to += 1
                runs = [_CANDIDATE.findall(t) for t in texts[at:to]]
                if held.secret:
                    reader.read(set().union(*runs))  # many values in step
                for text, own in zip(texts[at:to], runs, strict=True):
                    base, every = spans_of(text, own, held, reader)
                    n = Counter(k for _, _, k in base)
                    rows.append({"base": joined(base), "spans": joined(every), "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"]})
                at = to
            yield pa.array(rows, _ARROW)

    return docs.withColumn(out, F.arrow_udf(scan, _FOUND, F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")))

