"""Conversation repair against a search over all edits, and with conversations that run over many chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string, times string, chunk int, place long, edit string"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "e") for r in rows], KIND)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        of = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if of == 0:
            continue
        text = "" if of == 1 else re.sub("[.!?]", "", text) if of == 2 else text
        out += [(conv, turn, "user" if of == 4 else role, text)] * (2 if of == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by a best-first search over (row, roles so far), audits compared as text."""
    seen, start = {}, (0, "", 0, "", ())
    heap = [start]
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if seen.get((i, state), (cost, audit)) < (cost, audit) and seen[(i, state)][0] < cost:
            continue
        seen.setdefault((i, state), (cost, audit))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        turned = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[turned]
        if len(audit) < 3 * len(rows) + 3:
            heapq.heappush(heap, (cost + 3, audit + "I", i, turned, (*lines, full + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more, r = 3 * (fault == "truncated"), role[:1]
                to = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}, "": {x: x for x in ("", "s", "u", "a")}}.get(r, {}).get(state)
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, turned, (*lines, f"{full}:{text}")))
    raise AssertionError


def expected(rows):
    out, every = {}, {r[0] for r in rows}
    for conv in every:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        first = [r[2][:1] for r in own]
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def drawn(n, longest, seed, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(roles), r.choice(["Yes.", "No", "Why?  \n", "", " \t", None, f"Text {turn}.", f"Text {r.random()}", "ok!\x0b"])))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 8192])
def test_against_a_search_over_edits(spark, chunk_rows):
    rows = drawn(60, 9, 4) + [(None, 1, "user", "Hi."), (None, None, "user", "Hi."), (77, 5, "user", "x" * 100_000), (10**12, -4, "assistant", "A.")]
    assert got(cr.audited(table(spark, rows).repartition(3), chunk_rows)) == expected(rows)


def test_one_conversation_over_many_chunks(spark):
    """A conversation of a third of all rows; repeated rows, and a stretch that is all to be deleted."""
    r = random.Random(9)
    rows = [(5, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice([f"Text {t}.", f"cut {t}", "Same."])) for t in range(120)]
    rows += [(5, 200 + t, "user", "Same.") for t in range(60)] + [(5, 300, "user", "Again.")] * 40 + drawn(20, 6, 5)
    assert got(cr.audited(table(spark, rows), 10)) == expected(rows)


def test_costs_do_not_depend_on_chunks(spark):
    rows = [(1, t, "tool", "cut") for t in range(40)] + [(1, 100 + t, "tool", f"cut {t}") for t in range(300)]
    assert got(cr.audited(table(spark, rows), 7)) == got(cr.audited(table(spark, rows), 10_000))


def test_empty_and_dropped(spark):
    assert cr.audited(table(spark, [])).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(cr.audited(table(spark, [(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_lines_and_report_without_damage(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes.")]
    report, lines = cr.repair(table(spark, rows).drop("times"))
    assert [tuple(r) for r in report.collect()] == [(1, 0, 0, 0, 0, 1, 3, "KKIKK")]
    assert [(r.role, r.text) for r in lines.orderBy("place", "step").collect()] == [("system", "Be kind."), ("user", "Hi."), ("assistant", ""), ("user", "Are you there?"), ("assistant", "Yes.")]
    report, lines = cr.repair(table(spark, rows), F.lit(2))
    assert report.first().duplicate == 4 and lines.count() == 5
