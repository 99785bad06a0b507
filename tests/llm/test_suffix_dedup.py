from collections import Counter

import pytest

from lodestone.llm import suffix_dedup as S
from tests.llm.fixtures import docs, rows, words


def brute(data, length):
    texts = [(i, (t or "").encode()) for i, t in data]
    seen = Counter(x[k : k + length] for _, x in texts for k in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(spark, data, length, gram):
    got = S.suffix_dedup(docs(spark, data).repartition(3), length, gram)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str)


def data():
    passage = words(61, 60)
    shared = [(600 + i, f"{words(620 + i, 20 + i)} {passage} {words(640 + i, 10 + i)}") for i in range(15)]
    twice = words(63, 40)
    return [r for r in rows() if len(r[1] or "") < 20_000] + shared + [(700, f"{twice} mid {twice} é日本 {twice[:150]}"), (701, "ab" * 400), (702, "日本語" * 60)]


@pytest.mark.parametrize("length,gram", [(100, 16), (400, 48)])
def test_against_brute_force(spark, length, gram):
    assert run(spark, data(), length, gram) == brute(data(), length)


def test_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    assert run(spark, data(), 100, 16) == brute(data(), 100)


def test_parts_of_a_long_text(spark, monkeypatch):
    texts = [t.encode() for t in (words(64, 900), words(65, 10), words(64, 300))]
    import numpy as np

    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0] + [len(t) for t in texts])

    def starts(a):
        return sorted((t, s, p, h) for t, h, x, y, p in zip(*a, strict=True) for s in range(x, y + 1))

    whole = starts(S.anchors(flat, ends, 100, 16))
    monkeypatch.setattr(S, "PART", 777)
    assert starts(S.anchors(flat, ends, 100, 16)) == whole
    assert len(whole) == sum(max(0, len(t) - 99) for t in texts)


def test_repeated_suffixes():
    buffer = b"abcdefgh" + b"xx" + b"abcdefgh" + b"yy" + b"bcdefg"
    starts = list(range(len(buffer) - 3))
    seen = Counter(buffer[s : s + 4] for s in starts)
    assert S.repeated(buffer, starts, 4).tolist() == [seen[buffer[s : s + 4]] > 1 for s in starts]


def test_empty_table(spark):
    assert run(spark, [], 100, 16) == []
