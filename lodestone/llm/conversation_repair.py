"""Conversation structure repair: the cheapest edits that make each conversation's turns alternate, by parallel Viterbi.

Rows are dealt in their order over range partitions, the chunks; a conversation may run over any number of them.
Each chunk finds what it costs to go from its first row to the conversation's end, for each state of the
role pattern, from a speculative cost vector at its own end. Fix-up passes run a chunk again from its
successor's vector where that differs from the one it had by more than a constant, and stop inside the chunk at
the row where it no longer does. When no chunk changes, the vectors are those of the whole conversation up to a constant,
and each chunk traces its edits forward by them, for every state it may be entered in; the states entered are then joined up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, written

#: Rows of a chunk, about; a chunk is one task's part of the order.
CHUNK_ROWS = 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. The end may follow the first and the last.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3), "?": (None,) * 4}
#: The state after the role that a state lacks: user, and assistant after user.
TURNED = (2, 2, 3, 2)
KINDS = "sua?"  # an empty role has kind ''
END = [0, 2 * INSERT, INSERT, 0]
SPACE = " \t\n\x0b\x0c\r"
FORCED, CUT = 8, 16  # bits of a row's code beside its kind: must be deleted, is truncated


def shape(costs: list[int]) -> tuple[int, ...]:
    """A cost vector up to a constant."""
    least = min(costs)
    return tuple(c - least for c in costs)


def kind_of(code: int) -> str:
    return ("s", "u", "a", "?", "")[code & 7]


def before(code: int, after: list[int]) -> list[int]:
    """Costs to the end from each state before a row, from those after it."""
    w = [DELETE + c for c in after]
    if not code & FORCED:
        cut, kept = TRUNCATED * bool(code & CUT), NEXT[kind_of(code)]
        w = [min(w[x], cut + KEEP + (after[kept[x]] if kept[x] is not None else FAR), cut + REROLE + after[TURNED[x]]) for x in range(4)]
    w[2], w[3] = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return [min(w[0], INSERT + w[2]), min(w[1], INSERT + w[2]), w[2], w[3]]


def costs_of(codes: list[int], after: list[int]) -> list[list[int]]:
    """The cost vectors before each row, and the last one, after all."""
    out = [after]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def trace(codes: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[list[str], int]:
    """For each row the edits up to and with its own, by the cheapest and among these ASCII-least way on; the state reached.

    Each edit leads from a state to one other, so the least letter that keeps the cost is the least way. Inserts
    and reroles to assistant are told by a small letter. With `last`, a further entry has the inserts after the final row.
    """
    out = []

    def turned(letter: str) -> tuple[str, int]:
        to = TURNED[state]
        return (letter.lower() if to == 3 else letter), to

    for code, here, after in zip(codes, costs, costs[1:], strict=False):
        edits, kept, cut = "", NEXT[kind_of(code)][state], TRUNCATED * bool(code & CUT)
        while here[state] != DELETE + after[state] and here[state] == INSERT + here[TURNED[state]]:
            letter, state = turned("I")
            edits, kept = edits + letter, NEXT[kind_of(code)][state]
        if here[state] == DELETE + after[state]:
            edits += "D"
        elif kept is not None and here[state] == cut + KEEP + after[kept]:
            edits, state = edits + "K", kept
        else:
            letter, state = turned("R")
            edits += letter
        out.append(edits)
    if last:
        edits = ""
        while costs[-1][state] > 0:
            letter, state = turned("I")
            edits += letter
        out.append(edits)
    return out, state


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows after the contract's damage by crc32 of id and turn; times is 2 where a row is repeated."""
    blank = F.lit(" ")
    of = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    rows = df.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), of.alias("of")).filter("of <> 0")
    changed = F.when(F.col("of") == 1, "").when(F.col("of") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("of") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("of") == 3, 2).otherwise(1).alias("times"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest of the text) with their number, code and whether they are blank or a duplicate.

    Equal rows of a turn are one row with a number; a text is first where its conversation's least turn has it.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    read = rows.select("conv_id", "turn", "role", "times", F.sha2("text", 256).alias("digest"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    one = read.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    key = ["conv_id", "turn", "role", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = one.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("o")).select("conv_id", F.col("o.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    both = one.alias("r").join(first.alias("f"), _same("r", "f", key), "left").select("r.*", F.col("f.first").isNull().alias("again"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).when(initial == "", 4).otherwise(3)
    code = kind + F.when(F.col("blank") | F.col("again"), FORCED).otherwise(0) + F.when(F.col("cut") & ~F.col("blank"), CUT).otherwise(0)
    return both.select(*key, "times", "blank", "again", code.alias("code"))


def _chunks(facts: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows in order with their chunk and place, written; and pieces: a conversation's rows in one chunk as arrays."""
    n = max(1, -(-facts.count() // chunk_rows))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]
    dealt = facts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("chunk", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")
    piece = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "code", "times"))).alias("rows"))
    return rows, piece


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost vector before each piece, from the conversation's end or, for a piece that is not its last, from a guess of zeros."""
    for batch in batches:
        out = {"start": [], "left": [], "shift": []}
        for rows, last in zip(batch.column("rows").to_pylist(), batch.column("last").to_pylist(), strict=True):
            start = END if last else [0, 0, 0, 0]
            out["start"].append(list(shape(start)))
            out["left"].append(list(shape(costs_of([r["code"] for r in rows], start)[0])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "chunk", "last")), pa.array(out["start"], pa.list_(pa.int64())), pa.array(out["left"], pa.list_(pa.int64()))], ["conv_id", "chunk", "last", "start", "left"])


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces again from the vector of the piece after them, backward until the vector differs from the one before only by a constant."""
    for batch in batches:
        found = []
        for rows, was, start, left in zip(*(batch.column(c).to_pylist() for c in ("rows", "start", "wanted", "left")), strict=True):
            old, new = was, start
            for r in reversed(rows):
                old, new = before(r["code"], old), before(r["code"], new)
                if shape(old) == shape(new):
                    break
            else:
                left = list(shape(new))
            found.append(left)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "chunk", "last", "wanted")), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "chunk", "last", "start", "left"])


_VECTORS = "conv_id long, chunk int, last boolean, start array<long>, left array<long>"


def _converged(pieces: DataFrame) -> DataFrame:
    """The vectors of every piece after as many fix-up passes as it takes; pieces of one-chunk conversations need none."""
    state = written(pieces.select("conv_id", "chunk", "last", "rows").mapInArrow(_first_pass, _VECTORS), "vectors")
    long = pieces.filter("pieces > 1").select("conv_id", "chunk", F.lead("chunk").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("after"))
    while True:
        right = state.select("conv_id", F.col("chunk").alias("after"), F.col("left").alias("wanted"))
        asked = long.filter(F.col("after").isNotNull()).alias("l").join(right.alias("s"), _same("l", "s", ["conv_id", "after"])).select("l.conv_id", "l.chunk", "s.wanted")
        changed = written(asked.alias("a").join(state.filter("not last").alias("s"), _same("a", "s", ["conv_id", "chunk"])).filter("a.wanted <> s.start").select("s.*", "a.wanted"), "changed")
        if changed.isEmpty():
            return state
        again = changed.alias("c").join(pieces.alias("p"), _same("c", "p", ["conv_id", "chunk"])).select("c.*", "p.rows").mapInArrow(_fix_up, _VECTORS)
        kept = state.alias("s").join(changed.alias("c"), _same("s", "c", ["conv_id", "chunk"]), "left_anti")
        state = written(kept.unionByName(again), "vectors")


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece and each state it may be entered in: the state it leaves and its edits, one string a row."""
    for batch in batches:
        ways = []
        for rows, start, opening, last in zip(*(batch.column(c).to_pylist() for c in ("rows", "start", "opening", "last")), strict=True):
            codes = [r["code"] for r in rows]
            # Up to the same constant everywhere, so the trace's equations hold; the end's own vector has none.
            costs = costs_of(codes, END if last else start)
            ways.append([dict(zip(("edits", "leaves"), trace(codes, costs, x, last), strict=True)) if x == 0 or not opening else None for x in range(4)])
        kind = pa.list_(pa.struct([("edits", pa.list_(pa.string())), ("leaves", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(ways, kind)], ["conv_id", "chunk", "ways"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the running hash is held."""
    key, running, out = None, None, []
    for batch in batches:
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if running is None or conv != key:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = conv, hashlib.sha256(line.encode())
            else:
                running.update(b"\n" + line.encode())
        if out:
            yield pa.record_batch({"conv_id": pa.array([k for k, _ in out], pa.int64()), "sha": pa.array([h for _, h in out])})
            out = []
    if running is not None:
        yield pa.record_batch({"conv_id": pa.array([key], pa.int64()), "sha": pa.array([running.hexdigest()])})


def _edits(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows in order, each with its edits; and the pieces with theirs, of which a conversation's last has one entry more."""
    turns, piece = _chunks(_facts(rows), chunk_rows)
    by = Window.partitionBy("conv_id")
    heads = piece.select("conv_id", "chunk", F.count(F.lit(1)).over(by).alias("pieces"), (F.col("chunk") == F.max("chunk").over(by)).alias("last"), (F.col("chunk") == F.min("chunk").over(by)).alias("opening"))
    pieces = written(piece.alias("p").join(heads.alias("m"), _same("p", "m", ["conv_id", "chunk"])).select("p.*", "m.pieces", "m.last", "m.opening"), "pieces")
    ready = pieces.alias("p").join(_converged(pieces).alias("v"), _same("p", "v", ["conv_id", "chunk"])).select("p.conv_id", "p.chunk", "p.rows", "p.last", "p.opening", "v.start")
    ways = written(ready.mapInArrow(_traced, "conv_id long, chunk int, ways array<struct<edits:array<string>,leaves:int>>"), "ways")
    # A conversation's pieces are no more than the tasks that it runs over; of each, four states come together.
    all_maps = F.array_sort(F.collect_list(F.struct("chunk", F.transform("ways", lambda w: w["leaves"]).alias("leaves"))))
    walked = F.aggregate("maps", F.array(F.lit(0)), lambda seen, p: F.concat(seen, F.array(p["leaves"][F.element_at(seen, -1)])))
    steps = F.zip_with("maps", walked, lambda p, x: F.struct(p["chunk"].alias("chunk"), x.alias("state")))
    entered = ways.groupBy("conv_id").agg(all_maps.alias("maps")).select("conv_id", F.explode(steps).alias("e")).filter("e.chunk is not null").select("conv_id", "e.chunk", "e.state")
    chosen = ways.alias("w").join(entered.alias("e"), _same("w", "e", ["conv_id", "chunk"])).select("w.conv_id", "w.chunk", F.col("w.ways")[F.col("e.state")]["edits"].alias("edits"))
    done = written(chosen.alias("c").join(pieces.alias("p"), _same("c", "p", ["conv_id", "chunk"])).select("c.conv_id", "c.chunk", "c.edits", "p.rows", "p.last"), "edits")
    each = done.select(F.explode(F.slice(F.arrays_zip("rows", "edits"), F.lit(1), F.size("rows"))).alias("e")).select("e.rows.place", F.col("e.edits").alias("edit"))
    return written(turns.join(each, "place"), "told"), done


def _report(told: DataFrame, done: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation, from its rows' edits and, where order counts, from its pieces."""
    last, cut = F.upper(F.right("edit", F.lit(1))), F.col("code").bitwiseAND(CUT) > 0
    again = F.when(F.col("blank"), 0).otherwise(F.col("times") - F.when(F.col("again"), 0).otherwise(1))
    own = F.when(last == "D", DELETE).when(last == "R", REROLE).otherwise(KEEP) + F.when(cut & (last != "D"), TRUNCATED).otherwise(0)
    sums = told.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(again).alias("duplicate"),
        F.count_if((F.col("code").bitwiseAND(FORCED) == 0) & cut).alias("truncated"),
        F.sum(INSERT * (F.length("edit") - 1) + own + DELETE * (F.col("times") - 1)).alias("spent"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
    )
    letters = F.zip_with("edits", "rows", lambda e, r: F.concat(F.upper(e), F.repeat(F.lit("D"), F.coalesce(r["times"] - 1, F.lit(0)).cast("int"))))
    kinds = F.transform("rows", lambda r: F.substring(F.lit("sua?e"), F.lit(1) + r["code"].bitwiseAND(7), F.lit(1)))
    wrong = lambda pair: F.when(pair.isin("su", "ua", "au"), 0).otherwise(1)
    inner = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size("kinds"), F.lit(2))), F.lit(0), lambda n, i: n + F.when(i > F.size("kinds"), 0).otherwise(wrong(F.concat(F.get("kinds", i - 2), F.get("kinds", i - 1)))))
    repeats = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["times"] - 1)
    ends = F.when(F.col("last"), INSERT * F.length(F.element_at("edits", -1))).otherwise(0)
    piece = done.select("conv_id", "chunk", F.array_join(letters, "").alias("audit"), ends.alias("added"), "rows", kinds.alias("kinds"))
    piece = piece.select("conv_id", "chunk", "audit", "added", (inner + repeats).alias("inner"), F.element_at("kinds", 1).alias("head"), F.element_at("kinds", -1).alias("foot"))
    across = F.concat(F.lag("foot").over(Window.partitionBy("conv_id").orderBy("chunk")), F.col("head"))
    piece = piece.select("conv_id", "chunk", "audit", "added", (F.col("inner") + F.when(across.isNull(), 0).otherwise(wrong(across))).alias("illegal"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "")
    audits = piece.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("added").alias("added"), audit.alias("audit"))
    longs = [F.col(f"s.{c}").cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    return sums.alias("s").join(audits.alias("a"), _same("s", "a", ["conv_id"])).select("s.conv_id", *longs, F.col("a.illegal").cast("long").alias("illegal"), (F.col("s.spent") + F.col("a.added")).cast("long").alias("cost"), "a.audit")


def _lines(rows: DataFrame, told: DataFrame, done: DataFrame) -> DataFrame:
    """The repaired rows by (place, step): kept and reroled ones with their text, inserted ones with none."""
    key = ["conv_id", "turn", "role", "digest"]
    texts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "text").groupBy(*key).agg(F.first("text").alias("text"))
    new = F.when(F.col("letter").isin("i", "r"), "assistant").when(F.col("letter").isin("I", "R"), "user")
    stays = told.filter(~F.col("edit").endswith("D")).withColumn("letter", F.right("edit", F.lit(1)))
    own = stays.alias("r").join(texts.alias("t"), _same("r", "t", key)).select("r.conv_id", "r.place", F.length("r.edit").alias("step"), F.coalesce(new, F.col("r.role")).alias("role"), "t.text")
    at = F.posexplode(F.split("edit", "")).alias("step", "letter")
    put = told.filter(F.length("edit") > 1).select("conv_id", "place", F.expr("left(edit, length(edit) - 1)").alias("edit")).select("conv_id", "place", at)
    after = done.filter("last").select("conv_id", F.element_at("rows", -1)["place"].alias("place"), F.element_at("edits", -1).alias("edit")).filter("edit <> ''").select("conv_id", "place", at)
    after = after.withColumn("step", F.col("step") + 10)  # a row has two inserts before it at most
    return own.unionByName(put.unionByName(after).select("conv_id", "place", "step", new.alias("role"), F.lit("").alias("text")))


def repair(df: DataFrame, times: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, lines) of rows conv_id, turn, role, text; `times` tells how often a row is meant (once).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, a row for each conversation. lines:
    conv_id, place, step, role, text, the repaired conversations, ordered by place and step.

    Null role and text count as one space. A null conv_id is a conversation of its own; rows without a turn come
    first. Of one turn, rows are ordered by role and then by the SHA-256 of their text, so repeated rows stand
    together; equal texts are those of equal SHA-256. An empty role has no initial and may be kept anywhere; roles that begin
    otherwise than s, u or a are kept nowhere. Of a text the digest and its last character are read, whatever
    its length; tasks hold some hundred texts. An empty table gives no rows. Other columns are not read, whatever
    their names. A conversation takes as many fix-up passes as chunks that follow each other without bringing all
    vectors together (rows that are all to be deleted, say), mostly one.
    """
    small_batches(df.sparkSession)
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled, (F.lit(1) if times is None else times).cast("long").alias("times"))
    told, done = _edits(rows, chunk_rows)
    return _report(told, done), _lines(rows, told, done)


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of each conversation's `role:text` lines, joined by newlines. One task reads a conversation in order and holds one batch of it."""
    small_batches(lines.sparkSession)
    dealt = lines.select("conv_id", "place", "step", F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return dealt.select("conv_id", "line").mapInArrow(_digests, "conv_id long, sha string")


def audited(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The report with the repaired conversation's digest, for every conv_id of df, after `damaged`: zeros, an empty audit and the empty text's digest where all rows are dropped."""
    report, lines = repair(damaged(df), F.col("times"), chunk_rows)
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = every.alias("e").join(report.alias("r"), _same("e", "r", ["conv_id"]), "left").join(line_digests(lines).alias("h"), _same("e", "h", ["conv_id"]), "left")
    counts = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("e.conv_id", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("h.sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
