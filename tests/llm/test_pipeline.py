import pytest

import corpus_pipeline
from tests.llm.fixtures import docs, rows, words
from tests.llm.test_classifiers import corpus
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_jaccard_join import brute as joined


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic rows, copies, near copies and benchmark passages; labels for the first ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    data, labels = corpus()
    passage = words(5000, 14)
    more = [(10_000 + i, t) for i, t in rows() if i is not None and len(t or "") < 20_000] + [(20_000, f"{words(5001, 30)} {passage}"), (20_001, f"{words(5002, 900)} {passage}"), (20_002, words(5003, 60) + " 1d10t m0r0n")]
    docs(spark, data + more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    toxic = {i for i, t in corpus()[0] if i % 5 == 0} | {20_002}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, folder)
        after = ids(out)
        if name == "toxicity":
            assert set(before) - set(after) == toxic
        elif name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t or ""] = max(last.get(t or "", i), i)
            assert after == sorted(last.values())
        elif name == "ngram_jaccard_join":
            assert after == sorted(r[0] for r in joined(list(before.items())) if r[4])
        elif name == "benchmark_decontamination":
            passage = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text
            assert after == sorted(r[0] for r in contaminated(list(before.items()), [(1, passage)]) if not r[4])
            assert 20_000 not in after and 20_001 in after
        else:
            assert after == sorted(before) and out.filter("NOT round_trip").isEmpty()
            break
        assert out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
    assert ids(corpus_pipeline.run(spark, folder)) == after


def test_stages_take_odd_and_empty_tables(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), folder).collect() == []
        assert stage(spark, docs(spark), folder).count() > 0


def test_repeated_rows_leave_one(spark, folder):
    out = corpus_pipeline.drop_copies(spark, docs(spark, [(4, "x"), (4, "x"), (3, "x"), (None, "y"), (5, "z"), (5, "w")]), folder)
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id) == [(4, "x"), (5, "w"), (5, "z")]
    assert out.filter("doc_id is null").count() == 1


def test_columns_of_the_same_names_as_the_stages_own_come_back(spark, folder):
    from pyspark.sql import functions as F

    names = ("_toxicity_score", "toxicity_score", "contamination", "_contamination", "Hits", "found")
    d = docs(spark).withColumns({c: F.lit("MINE") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert [tuple(r) for r in d.select(*names).distinct().collect()] == [("MINE",) * len(names)]
