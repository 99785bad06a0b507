"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, unused, with_group, written
from lodestone.llm.pieces import LOW, MARK, PATH, Decoder, Lattice, Vocabulary, normalised, pretokens

#: Texts of more characters are split into chunks of so many characters.
GIANT, CHUNK = 1 << 16, 1 << 15
#: Chunks, or groups of them, whose matrices are combined by one call.
FAN = 16
REMEMBERED, AT_ONCE = 400_000, 1 << 20


class Encoder:
    """Texts -> packed ids, remembering the words that it has met."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.known = lattice, {}
        self.lost: set[str] = set()  # remembered words that their ids do not decode to

    def _learn(self, words: set[str], decoder: Decoder | None) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.lost.clear()
        new = list(words - self.known.keys())
        packed = self.lattice.encode_words(new)
        self.known.update(zip(new, packed, strict=True))
        if decoder and new:
            self.lost.update(decoder.lost(new, packed))

    def encode(self, texts: list[str], decoder: Decoder | None = None) -> tuple[list[bytes], list[bool]]:
        """Ids of each text and, with a decoder, whether they decode to it.

        Words are encoded and decoded once; a text decodes to its words one after another. Texts are taken AT_ONCE
        characters at a time.
        """
        out: list[bytes] = []
        same: list[bool] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            split = [pretokens(t) for t in texts[at:to]]
            self._learn(set().union(*split), decoder)
            known, lost = self.known, self.lost
            out.extend(b"".join(map(known.__getitem__, words)) for words in split)
            if decoder:
                same.extend(MARK not in t and (not lost or lost.isdisjoint(words)) for t, words in zip(texts[at:to], split, strict=True))
            at = to
        return out, same


def _cuts(text: str) -> tuple[int, int]:
    """The first and last places inside that no piece crosses: a mark after another character. (-1, -1) if there is none."""
    first = last = -1
    at = text.find(MARK, 1)
    while at > 0 and text[at - 1] == MARK:
        at = text.find(MARK, at + 1)
    if at > 0:
        first = at
        at = text.rfind(MARK)
        while text[at - 1] == MARK:
            at -= 1
        last = at if at >= first else first
    return first, last


class Chunk:
    """One chunk of a giant text: `size` characters of its own, then up to a piece's length of what follows."""

    def __init__(self, encoder: Encoder, text: str, size: int):
        self.encoder, self.lattice, self.text, self.size = encoder, encoder.lattice, text, size
        self.first, self.last = _cuts(text[:size])
        self.states = self.lattice.longest

    def matrix(self) -> np.ndarray:
        """[i, j]: best score when the piece before reaches i characters into this chunk and the last one j beyond it."""
        out = np.full((self.states, self.states), LOW, np.int64)
        entries = list(range(self.states))
        beyond = min(len(self.text) - self.size, self.states - 1)
        if self.first < 0:
            best, _, _ = self.lattice.transfers(self.text, entries, self.size)
            out[:, : beyond + 1] = best[self.size : self.size + beyond + 1].T
            for i in entries:  # an entry beyond the chunk's own text is carried on as it is
                if self.size <= i <= self.size + beyond:
                    out[i, i - self.size] = 0
            return out
        head, _, _ = self.lattice.transfers(self.text[: self.first], entries, self.first)
        tail, _, _ = self.lattice.transfers(self.text[self.last :], [0], self.size - self.last)
        middle = self.lattice.score(self.middle())
        i, j = head[self.first], tail[self.size - self.last : self.size - self.last + beyond + 1, 0]
        both = (i[:, None] > LOW // 2) & (j[None, :] > LOW // 2)
        out[:, : beyond + 1] = np.where(both, i[:, None] + j[None, :] + middle, LOW)
        return out

    def middle(self) -> bytes:
        words = _stretches(self.text[self.first : self.last])
        self.encoder._learn(set(words), None)
        return b"".join(map(self.encoder.known.__getitem__, words))

    def ids(self, entry: int, leave: int) -> bytes:
        """Packed ids of the pieces that start in this chunk, on the path between two boundary states."""
        if entry >= self.size:
            return b""
        if self.first < 0:
            return self.lattice.path(self.text, entry, self.size + leave, self.size)
        head = self.lattice.path(self.text[: self.first], entry)
        tail = self.lattice.path(self.text[self.last :], 0, self.size - self.last + leave, self.size - self.last)
        return head + self.middle() + tail


def _stretches(text: str) -> list[str]:
    from lodestone.llm.pieces import _STRETCH

    return _STRETCH.findall(text)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices; associative."""
    total = a[:, :, None] + b[None, :, :]
    out = total.max(1)
    return np.where(out > LOW // 2, out, LOW)


def choose(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """The boundary states of each of a row of chunks on the best path between two states."""
    forward = [np.full(len(matrices[0]), LOW, np.int64)]
    forward[0][entry] = 0
    for m in matrices:
        v = (forward[-1][:, None] + m).max(0)
        forward.append(np.where(v > LOW // 2, v, LOW))
    states, at = [], leave
    for k in range(len(matrices) - 1, -1, -1):
        before = int((forward[k] + matrices[k][:, at]).argmax()) if k else entry
        states.append((before, at))
        at = before
    return states[::-1]


def _pack(m: np.ndarray) -> bytes:
    return m.astype("<i8").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n = math.isqrt(len(b) // 8)
    return np.frombuffer(b, "<i8").reshape(n, n)


def _upward(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    m = [_unpack(b) for b in table.column("matrix").to_pylist()]
    total = m[0]
    for x in m[1:]:
        total = combined(total, x)
    return pa.table({"key": table.column("key")[:1], "place": pa.array([table.column("place")[0].as_py() // FAN], pa.int64()), "matrix": pa.array([_pack(total)], pa.binary())})


def _downward(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    states = choose([_unpack(b) for b in table.column("matrix").to_pylist()], table.column("entry")[0].as_py(), table.column("leave")[0].as_py())
    return pa.table({"key": table.column("key"), "place": table.column("place"), "entry": pa.array([a for a, _ in states], pa.int32()), "leave": pa.array([b for _, b in states], pa.int32())})


def _gathered(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    return pa.table({"key": table.column("key")[:1], "ids": pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())})


def scan(giants: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) for giant texts (key, text): chunks in parallel, whatever the length of a text.

    Every chunk yields its matrix; matrices of FAN neighbours are combined level by level up to one for
    the text; back down, each level hands its chunks their boundary states; then chunks are backtraced
    on their own.
    """
    sent = giants.sparkSession.sparkContext.broadcast(vocabulary)
    ahead = max(map(len, vocabulary.pieces)) - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = normalised(text)
                for place, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([place], pa.int64()), pa.array([min(chunk, len(text) - at)], pa.int64()), pa.array([text[at : at + chunk + ahead]])], ["key", "place", "size", "text"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Lattice(sent.value))
        for batch in batches:
            found = [_pack(Chunk(encoder, t, n).matrix()) for t, n in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), pa.array(found, pa.binary())], ["key", "place", "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Lattice(sent.value))
        for batch in batches:
            found = [Chunk(encoder, t, n).ids(a, b) for t, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), pa.array(found, pa.binary())], ["key", "place", "ids"])

    chunks = written(giants.mapInArrow(split, "key string, place long, size long, text string").repartition("key", "place"), "chunks")
    levels = [written(chunks.mapInArrow(matrices, "key string, place long, matrix binary"), "matrices")]
    most = (levels[0].agg(F.max("place")).first()[0] or 0) + 1
    while most > 1:
        up = levels[-1].withColumn("over", F.floor(F.col("place") / FAN)).groupBy("key", "over").applyInArrow(lambda t: _upward(t.drop_columns(["over"])), "key string, place long, matrix binary")
        levels.append(written(up, "matrices"))
        most = -(-most // FAN)
    states = levels[-1].select("key", F.lit(0).cast("long").alias("place"), F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in levels[-2::-1]:
        over = states.select("key", F.col("place").alias("over"), "entry", "leave")
        down = level.withColumn("over", F.floor(F.col("place") / FAN)).join(over, ["key", "over"])
        states = written(down.groupBy("key", "over").applyInArrow(_downward, "key string, place long, entry int, leave int"), "states")
    traced = chunks.join(states, ["key", "place"]).mapInArrow(trace, "key string, place long, ids binary")
    return traced.groupBy("key").applyInArrow(_gathered, "key string, ids binary")


def encode(docs: DataFrame, path: str = PATH, text_col: str = "text", out: str = "ids", giant: int = GIANT, chunk: int = CHUNK, round_trip: str | None = None) -> DataFrame:
    """docs with a binary column `out` more: piece ids as little-endian 32-bit numbers.

    round_trip names a boolean column to add: whether the ids decode to the text, told by the same pass.

    The encoding is the segmentation of greatest summed piece score over the whole text; characters in no
    piece are spelled in byte pieces. Null and empty texts have no ids. Texts of more than `giant`
    characters are scanned in chunks, equal ones once. Row order is not kept. Other columns come back as they are, whatever
    their names, but for those named by out and round_trip.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(path)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [c for c in docs.columns if c not in (out, round_trip)]
    made, at = pa.struct([("ids", pa.binary()), ("same", pa.bool_())]), unused(docs, "made")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(Lattice(sent.value)), Decoder(sent.value)
        for texts in batches:
            texts = texts.to_pylist()
            packed, same = encoder.encode(texts, decoder if round_trip else None)
            same = same or [None] * len(texts)
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(same, pa.bool_())], fields=list(made))

    def shaped(df: DataFrame, columns: list, ids, same) -> DataFrame:
        return df.select(*columns, ids.alias(out), *([same.alias(round_trip)] if round_trip else []))

    each = docs.filter(F.length(text) <= giant).withColumn(at, F.arrow_udf(run, "struct<ids:binary,same:boolean>", F.ArrowUDFType.SCALAR_ITER)(text))
    short = shaped(each, [F.col(f"`{c}`") for c in kept], F.col(f"{at}.ids"), F.col(f"{at}.same"))
    giants = docs.filter(F.length(text) > giant)
    key = F.sha2(text, 256)
    distinct = giants.select(key.alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "giants")
    if distinct.isEmpty():
        return short
    ids = written(scan(distinct.select("key", "text"), vocabulary, chunk).join(distinct.select("key", "n"), "key"), "ids")
    if round_trip:
        told = decode(ids, path, "ids", "_decoded").withColumn("_same", F.sha2("_decoded", 256) == F.col("key")).drop("_decoded")
        ids = written(told, "ids")
    names = {c: f"_{i}" for i, c in enumerate(kept)}  # no clash with the join's own columns
    renamed = giants.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), key.alias("_key"))
    joined = with_group(renamed, ids.withColumnRenamed("key", "_key"), "_key", "n", F.xxhash64(*renamed.columns))
    return short.unionByName(shaped(joined, [F.col(n).alias(c) for c, n in names.items()], F.col("ids"), F.col("_same") if round_trip else F.lit(None)))


def decode(df: DataFrame, path: str = PATH, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a string column `out` more: the text of packed ids (null as no ids)."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(sent.value)
        for rows in batches:
            yield pa.array([decoder.decode(x.as_py() or b"") for x in rows], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{ids_col}`")))
