import base64
import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import secrets as X
from lodestone.llm import warc as W
from lodestone.llm.common import shared_dir
from tests.llm.fixtures import docs, rows, words

SMALL = "/root/testdata/sf0.001"


def plain(text):
    """The contract's reading: all matches of each pattern, the short ones dropped."""
    out = []
    for k, (p, ok) in enumerate([(X.ASSIGN, lambda m: len(m[2]) >= 6), (X.ACCESS, lambda m: len(m[0]) >= 20), (X.HEX, lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return [(a, b, X.KINDS[k]) for a, k, b in sorted(out)]


KEYS = [f"AKIA{hashlib.md5(str(i).encode()).hexdigest().upper()[:16]}" for i in range(40)]
HEXES = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]


def secret_rows():
    out = [(1000 + i, f"{words(i, 10)} {KEYS[i]} {words(i + 50, 5)} api_key = \"{HEXES[i][:20]}\" x {HEXES[-i]}") for i in range(40)]
    odd = ["password: short", "PassWord:hunter22", "token=ab secret=abcdef1", "password=token=abcdef", "AKIAAKIA" + "Z" * 16, "é" * 5 + "apikey='0123456'", "AKIASHORT", "f" * 24, "F" * 24, "ſecret=abcdefg", "toKen: abcdefgh", "secret = " + "a" * 9000]
    return out + [(2000 + i, t) for i, t in enumerate(odd)]


def test_base_spans_are_those_of_the_patterns():
    for _, t in rows() + secret_rows():
        assert X.base_spans(t or "") == plain(t or "")


def test_query_rows_and_spans_of_the_method(spark):
    data = rows() + secret_rows() + [(3000, f"look {HEXES[3].upper()} and {KEYS[0][4:]}"), (3001, words(9, 200))]
    d = docs(spark, data)
    model = X.learn(d)
    assert model.formats.kinds == X.KINDS
    out = X.secrets(d, model)
    assert out.columns == [*d.columns, "secrets"] and out.count() == len(data)
    for r in out.collect():
        base = plain(r.text or "")
        n = Counter(k for _, _, k in base)
        assert (r.secrets.n_assign, r.secrets.n_access, r.secrets.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.secrets.base == X.joined(base) and set(filter(None, r.secrets.base.split(","))) <= set(r.secrets.spans.split(","))
        if r.doc_id == 3001:
            assert r.secrets.spans == ""
    assert X.secrets(docs(spark, []), X.learn(docs(spark, []))).collect() == []


def inferred(values):
    return X.Automaton().prefix_tree(Counter(map(X.symbols, values))).merged()


def reference_reading(automaton, value):
    """The same likelihood by a plain walk over the tables."""
    to, logp = automaton.tables()
    at, total = 0, 0.0
    for c in X.symbols(value):
        total, at = total + logp[at, c], to[at, c]
    code = [*X.symbols(value), X.END]
    alike = -math.log(X.SYMBOLS) * len(code)
    runs = -math.log(X.SYMBOLS) + sum(math.log((X.RUNS if a == b else 0) + (1 - X.RUNS) / X.SYMBOLS) for a, b in zip(code, code[1:], strict=False))
    return at, total + logp[at, X.END] - max(alike, runs)


def test_states_merge_and_values_are_read_as_by_a_plain_walk():
    tree = X.Automaton().prefix_tree(Counter(map(X.symbols, HEXES)))
    states = len(tree.visits)
    made = tree.merged()
    to, logp = made.tables()
    assert len(to) < states / 10 and np.allclose(np.exp(logp).sum(1), 1)
    assert sum(made.ends[s] for s in {made.find(s) for s in range(states)}) == len(HEXES)  # no word is lost or counted twice
    values = [*HEXES, "abcdef", "x" * 700, "sk_live_1", HEXES[0][:39], "9" * 5000]
    state, margin = X.Formats.of({"hex": made}).read(values)
    for v, s, m in zip(values, state, margin, strict=True):
        want = reference_reading(made, v)
        assert s == want[0] and abs(m - want[1]) < 1e-6


def test_a_fixed_length_stays_a_chain_and_open_lengths_fold_into_loops():
    formats = X.Formats.of({"hex": inferred(HEXES)})
    (whole, *_), margin = formats.read([HEXES[0], *(HEXES[0][:n] for n in range(24, 40))])
    assert whole not in formats.read([HEXES[0][:n] for n in range(24, 40)])[0] and margin[0] > X.MARGIN
    r = random.Random(3)
    lengths = [30 + min(300, int(r.expovariate(0.05))) for _ in range(1500)]
    loops = inferred("".join(r.choice("abcdefghij0123456789") for _ in range(n)) for n in lengths)
    assert len(loops.tables()[0]) < max(lengths) / 2


def test_long_values_are_learned_from_and_scored_whole():
    r = random.Random(9)
    long_ = ["".join(r.choice("ABCDEFGHIJK0123456789") for _ in range(700)) for _ in range(30)]
    state, margin = X.Formats.of({"assign": inferred(long_)}).read([*long_, "".join(long_)])
    assert len(set(state)) == 1 and (margin >= X.MARGIN).all()


def planted(seed):
    """Sixty labelled and sixty bare credentials of three formats, and ordinary rows that look alike."""
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    make = [lambda: "sk_live_" + "".join(r.choice(letters) for _ in range(24)), lambda: "ghp_" + "".join(r.choice(letters) for _ in range(36)), lambda: hashlib.sha1(str(r.random()).encode()).hexdigest().upper()]
    labelled = [(10_000 + 100 * k + i, f'{words(i, 20)} api_key = "{f()}" {words(i + 70, 20)}') for k, f in enumerate(make) for i in range(60)]
    bare = [(20_000 + 100 * k + i, f()) for k, f in enumerate(make) for i in range(60)]
    plain_ = [(30_000 + i, f"{words(i, 20)} {4000000000000000 + i * 7919} and 10.{i}.{i + 3}.{i + 99} mail{i}.example.com {'x' * (6 + i)} {words(i + 9, 20)}") for i in range(120)]
    return labelled, bare, plain_


def test_bare_values_of_learned_formats_are_found_and_nothing_else(spark):
    labelled, bare, plain_ = planted(1)
    d = docs(spark, labelled + [(i, f"see {v}. Then") for i, v in bare] + plain_ + rows())
    out = {r.doc_id: r.secrets for r in X.secrets(d, X.learn(d)).filter("doc_id is not null").collect()}
    found = [i for i, v in bare if out[i].spans == f"likely-assign:4:{4 + len(v)}" and out[i].base == ""]
    false = [i for i, s in out.items() if i < 20_000 or i >= 30_000 if s.spans != s.base]
    assert len(found) >= 0.95 * len(bare) and not false


def test_many_bare_values_are_found_as_well(spark):
    """Sixty labelled and 900 bare values of each format: the spans are the planted ones, and no others."""
    labelled, _, plain_ = planted(2)
    r = random.Random(11)
    letters = string.ascii_letters + string.digits
    make = [lambda: "sk_live_" + "".join(r.choice(letters) for _ in range(24)), lambda: "ghp_" + "".join(r.choice(letters) for _ in range(36)), lambda: hashlib.sha1(str(r.random()).encode()).hexdigest().upper()]
    bare = [(40_000 + 1000 * k + i, f()) for k, f in enumerate(make) for i in range(900)]
    d = docs(spark, labelled + [(i, f"see {v}. Then") for i, v in bare] + plain_ + rows())
    out = {x.doc_id: x.secrets for x in X.secrets(d, X.learn(d)).filter("doc_id is not null").collect()}
    for k in range(len(make)):
        own = [(i, v) for i, v in bare if (i - 40_000) // 1000 == k]
        assert sum(out[i].spans == f"likely-assign:4:{4 + len(v)}" for i, v in own) >= 0.95 * len(own), k
    assert not [i for i, s in out.items() if i < 40_000 and s.spans != s.base]


def test_a_format_that_the_corpus_mostly_uses_otherwise_adds_nothing(spark):
    data = [(i, f"password: {w}") for i, w in enumerate(["something", "required", "forgotten"])] + [(100 + i, " ".join(["something", "required", "forgotten", "everything"])) for i in range(50)]
    d = docs(spark, data)
    assert X.secrets(d, X.learn(d)).filter("secrets.spans <> secrets.base").isEmpty()


def test_registered_query_against_plain_reading(spark):
    """Base columns by the plain patterns; every other span is a candidate whose format the model calls secret."""
    from lodestone.llm import queries

    d = queries.table(spark, SMALL, "documents")
    model, text = X.learn(d), {r.doc_id: r.text or "" for r in d.collect()}
    got = queries.QUERIES["op7_secret_scan"](spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        base = plain(text[r.doc_id])
        n = Counter(k for _, _, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(X.joined(base).encode()).hexdigest()
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert [":".join(s) for s in every if not s[0].startswith("likely")] == [f"{k}:{a}:{b}" for a, b, k in base]
        want = {(a, b) for a, b in X.candidates(text[r.doc_id], base) if (s := model.formats.read([text[r.doc_id][a:b]]))[1][0] >= X.MARGIN and X.cell(text[r.doc_id][a:b], int(s[0][0])) in model.secret}
        assert {(int(a), int(b)) for k, a, b in every if k.startswith("likely")} == want


def pages(spark, data):
    return spark.createDataFrame([(i, f"http://x/{i}" if i else None, h, 1) for i, h in data], "page_id long, url string, html string, digest int")


PAGES = [(1, "<p>same</p>"), (2, "<p>same</p>"), (9, "<p>same</p>"), (3, None), (4, ""), (5, "<b>é日本</b>" * 50), (6, "x" * 200_000), (None, "lone"), (7, "<p>same</p>"), (7, "<p>same</p>"), (8, "a\r\n\r\nb\r\n\r\n")] + [(100 + i, f"<html>{words(i, 30)}</html>") for i in range(60)]


def test_round_trip(spark):
    got = W.warc_round_trip(pages(spark, PAGES).repartition(3))
    last = {}
    for i, h in PAGES:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, h in PAGES:
        p = (h or "").encode()
        ref = last.get(h or "")
        ref = None if ref == i or ref is None else ref
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if ref is not None else "response", ref, None if ref is not None else h or ""))
    rows_ = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got.collect()]
    assert sorted(rows_, key=str) == sorted(want, key=str)


def test_empty_table_and_least_bytes(spark):
    assert W.warc_round_trip(pages(spark, [])).collect() == []
    big = W.with_revisits(pages(spark, PAGES), 12).filter(F.col("refers_to").isNotNull())
    assert big.collect() == []


def test_archive_layout(spark):
    """The dictionary stands in a leading skippable frame, and each record is a frame of its own."""
    import pyarrow.fs
    import zstandard

    folder = f"{shared_dir(spark)}/layout"
    p = pages(spark, PAGES)
    dictionary = W.build_dictionary(p)
    assert dictionary
    names = [r.archive for r in W.write_archives(W.with_revisits(p), folder, dictionary).collect()]
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    records = 0
    for name in names:
        data = fs.open_input_stream(f"{root}/{name}", compression=None).read()
        assert data[:4] == bytes.fromhex("5d2a4d18") and data[8 : 8 + len(dictionary)] == dictionary
        for record in W.read_archive(data):
            fields, _ = W.parse_record(record)
            assert re.fullmatch(r"sha1:[A-Z2-7]{32}", fields["warc-payload-digest"])
            records += 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(W.read_archive(data[:-3]))
    assert records == len(PAGES)
