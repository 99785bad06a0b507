import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality, toxicity
from tests.llm.fixtures import docs, rows, words


def corpus():
    r = random.Random(3)
    out, labels = [], []
    for i in range(600):
        t = words(1000 + i, r.randint(40, 90))
        good, toxic = i % 3 > 0, i % 5 == 0
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "trash"]))
            t = " ".join(w)
        out.append((i, t))
        labels.append((i, int(good), int(toxic)))
    return out, labels


@pytest.fixture(scope="module")
def tables(spark):
    data, labels = corpus()
    return docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def scores(df, col):
    return {r[0]: r[1] for r in df.select("doc_id", col).collect()}


def test_quality_held_out(spark, tables):
    d, labels = tables
    model = quality.train(d, labels.filter("doc_id % 4 <> 0"))
    got = scores(quality.quality(d, model, out="s"), "s")
    held = [(got[r.doc_id] >= 0.3, r.quality == 1) for r in labels.filter("doc_id % 4 = 0").collect()]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= v <= 1 for v in got.values())


def test_quality_odd_rows(spark, tables):
    d, labels = tables
    model = quality.train(d, labels)
    out = quality.quality(docs(spark), model, out="s")
    assert out.columns == [*docs(spark).columns, "s"] and out.count() == len(rows()) and out.filter("s IS NULL OR s < 0 OR s > 1").isEmpty()
    same = {r.doc_id: r.s for r in out.filter("doc_id IN (1, 2, 9, 5, 6)").collect()}
    assert same[1] == same[2] == same[9] and same[5] == same[6]
    none = quality.train(docs(spark, []), labels.limit(0))
    assert set(scores(quality.quality(docs(spark), none, out="s"), "s").values()) == {0.5}
    assert quality.quality(docs(spark, []), model).collect() == []


def test_toxicity_held_out_and_obfuscated(spark, tables):
    d, labels = tables
    model = toxicity.train(d, labels.filter("doc_id % 4 <> 0"))
    got = scores(toxicity.toxicity(d, model, out="s"), "s")
    held = [(got[r.doc_id] >= 0.3, r.toxic == 1) for r in labels.filter("doc_id % 4 = 0").collect()]
    assert np.mean([a == b for a, b in held]) > 0.97
    hidden = ["1d10t", "i d i o t", "m0r0n", "m.o.r.o.n", "7rash", "idiooot", "t-r-a-s-h", "mmoron", "iiddiioott", "1d107", "tr@$h", "7r4$h", "id iot", "mo\nr on,", "i\u00a0d\u00a0i\u00a0o\u00a0t", "m\no\nr\no\nn", "moron!"]
    test = [(i, f"{words(5, 30)} {h} {words(6, 30)}") for i, h in enumerate(hidden)] + [(100 + i, words(900 + i, 60)) for i in range(20)]
    found = scores(toxicity.toxicity(docs(spark, test), model, out="s"), "s")
    assert all((v >= 0.3) == (k < 100) for k, v in found.items()), found


def test_toxicity_odd_rows(spark, tables):
    d, labels = tables
    model = toxicity.train(d, labels)
    out = toxicity.toxicity(docs(spark), model, out="s")
    assert out.columns == [*docs(spark).columns, "s"] and out.count() == len(rows()) and out.filter("s IS NULL OR s >= 0.3").isEmpty()
    none = toxicity.train(docs(spark, []), labels.limit(0))
    assert set(scores(toxicity.toxicity(docs(spark), none, out="s"), "s").values()) == {0.5}
    assert toxicity.toxicity(docs(spark, []), model).collect() == []


def test_viterbi_is_the_best_path(spark, tables):
    """The decoder's path against all paths of the lattice."""
    d, _ = tables
    model = toxicity.character_model(d)
    restorer = toxicity.Restorer(model)

    def best(seen):
        paths = [(0.0, 0, "", "")]
        for at, c in enumerate(seen + "\n"):
            after = []
            again = None
            if 0 < at < len(seen) and c == seen[at - 1]:
                run = len(seen[:at]) - len(seen[:at].rstrip(c)) + len(seen[at:].rstrip("\n")) - len(seen[at:].rstrip("\n").lstrip(c))
                again = toxicity.TWICE if run == 2 else toxicity.REPEATED
            for score, context, text, _ in paths:
                for w, sym, cost in [(" ", 0, 0.0)] if c == "\n" else restorer._ways(c, again):
                    if sym < 0 or (sym == 0 and context % toxicity.SYMBOLS == 0):
                        after.append((score + cost, context, text, c))
                    else:
                        g = context * toxicity.SYMBOLS + sym
                        after.append((score + cost + restorer.model[g], g % toxicity.SYMBOLS**3, text + w, c))
            paths = after
        return max(paths)[2]

    for seen in ("1d10t", "m0r.0n", "i d i", "idiooot", "mmoron", "iiddiioott", "t|r@", "9+$"):
        assert restorer.restore(seen) == best(seen)


def test_restore_keeps_clean_text(spark, tables):
    model = toxicity.character_model(tables[0])
    out = toxicity.restore(docs(spark, [(1, words(3, 20)), (2, None), (3, "so 1d10t!")]), model)
    got = scores(out, "restored")
    assert got[1] == words(3, 20) and got[2] is None and "idiot" in got[3]
    assert out.filter(F.col("_group") == "g").count() == 3


@pytest.mark.parametrize(("name", "label", "modulus", "remainder"), [("op1_quality_classifier", "quality", 5, 0), ("op3_toxicity", "toxic", 4, 2)])
def test_registered_queries_keep_to_their_folds(spark, name, label, modulus, remainder, tmp_path):
    """Folds, cut and columns of the contract; labels of the held-out fold change no score."""
    import zlib

    from lodestone.llm import queries

    small = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, small)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    first = {r.doc_id: r for r in got.collect()}
    assert first.keys() == {r.doc_id for r in queries.table(spark, small, "documents").select("doc_id").collect()}
    for i, r in first.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    other = str(tmp_path)
    queries.table(spark, small, "documents").write.parquet(f"{other}/documents.parquet")
    fold = queries.held_out(modulus, remainder)
    queries.table(spark, small, "labels").withColumn(label, F.when(fold, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{other}/labels.parquet")
    again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in first.items())


def test_one_very_long_noisy_stretch(spark, tables):
    model = toxicity.train(*tables)
    out = toxicity.toxicity(docs(spark, [(1, "m0r0n" * 4000), (2, "a.b" * 20000), (3, "\n".join("x" * 30000))]), model, out="s")
    assert all(0 <= r.s <= 1 for r in out.collect())


def test_stretches_left_out_show_nothing(spark, tables):
    """Features with and without the look ahead whether a doubled stretch can show something."""
    model = toxicity.train(*tables)
    reader, every = toxicity.Reader(model.characters, model.lexicon), toxicity.Reader(model.characters, model.lexicon)
    every._matters = lambda seen, plain: True
    r = random.Random(8)
    for _ in range(400):
        w = r.choice(["idiot", "moron", "trash", "ionerly", "letter", "thanou"])
        seen = "".join(c * r.choice([1, 1, 2, 3]) for c in w)
        assert set(reader._of(seen)) == set(every._of(seen)), seen
