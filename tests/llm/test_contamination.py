import re

from pyspark.sql import functions as F

from lodestone.llm import contamination as C
from tests.llm.fixtures import docs, rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(data, items):
    out = []
    for i, t in data:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            for k in range(max(1, len(v) - 12) if v else 0):
                win = v[k : k + 13]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, data, items):
    b = spark.createDataFrame(items, "item_id long, text string, contamination int")
    found = C.contamination(docs(spark, data), b)
    return sorted(((r.doc_id, r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"]), r.contamination.contaminated) for r in found.collect()), key=str)


ITEMS = [(1, words(2, 100), 0), (2, "One-TWO", 0), (30, words(71, 14), 0), (4, None, 0), (5, "", 0), (6, words(5, 20), 0), (7, words(71, 14), 0), (8, "th", 0)]


def data():
    long_ = words(3, 3000) + " " + words(71, 14)
    return [r for r in rows() if len(r[1] or "") < 50_000] + [(100, long_), (101, words(9, 5) + " " + words(71, 14).upper() + "! " + words(10, 5)), (102, " ".join(words(71, 14).split()[:12]))]


def test_against_brute_force(spark):
    assert run(spark, data(), ITEMS) == brute(data(), [x[:2] for x in ITEMS])


def test_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(C, "PASS_BYTES", 500)
    assert run(spark, data(), ITEMS) == brute(data(), [x[:2] for x in ITEMS])


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], ITEMS) == []
    assert all(r[2] == 0 and not r[4] for r in run(spark, data(), []))
    b = spark.createDataFrame([x[:2] for x in ITEMS], "item_id long, text string")
    out = C.contamination(docs(spark), b, out="found")
    assert out.columns == [*docs(spark).columns, "found"] and out.filter(F.col("_group") == "g").count() == len(rows())


def test_wu_manber_finds_overlapping_occurrences():
    text = b"abababcabab" * 50
    patterns = [b"abab", b"babc", b"cabab", b"abcab"]
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert sorted(C.WuManber(patterns).occurrences(text)) == want


def test_columns_of_the_same_names_as_its_own_come_back(spark):
    d = docs(spark).withColumns({c: F.lit("MINE") for c in ("_hits", "_found", "hits", "FOUND", "hits_")})
    items = spark.createDataFrame([(1, rows()[0][1])], "item_id long, text string")
    got = C.contamination(d, items).select("_hits", "_found", "hits", "FOUND", "hits_").distinct().collect()
    assert [tuple(r) for r in got] == [("MINE",) * 5]
