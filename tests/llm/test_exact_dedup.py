import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as module
from lodestone.llm.exact_dedup import CuckooIndex, build_index, collisions, exact_dedup, update_index
from lodestone.llm.queries import exact_dedup_update
from tests.llm.fixtures import docs, rows


def weak(text):
    """A digest of seven values: most texts share one with others."""
    return F.lpad(F.hex(F.crc32(text.cast("binary")) % 7), 64, "0")


def expected(data):
    ids, n = defaultdict(list), defaultdict(int)
    for i, t in data:
        n[t or ""] += 1
        if i is not None:
            ids[t or ""].append(i)
    out = []
    for i, t in data:
        keep = max(ids[t or ""], default=None)
        out.append((i, keep, n[t or ""], i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_a_dictionary(spark):
    got = exact_dedup(docs(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows())


def test_hot_group_and_empty_table(spark):
    data = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    assert sorted((tuple(r) for r in exact_dedup(docs(spark, data).repartition(7)).collect()), key=str) == expected(data)
    assert exact_dedup(docs(spark, [])).collect() == []


def test_contents_of_one_digest_are_told_apart(spark):
    assert sorted((tuple(r) for r in exact_dedup(docs(spark), digest=weak).collect()), key=str) == expected(rows())
    data = [(i, "same" if i % 3 else f"text {i}") for i in range(900)] + [(None, None), (5, "same"), (5, "long " * 50_000), (6, "long " * 50_000)]
    assert sorted((tuple(r) for r in exact_dedup(docs(spark, data).repartition(5), digest=weak).collect()), key=str) == expected(data)


def test_collisions_name_only_digests_of_several_contents(spark):
    data = docs(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "d")])
    named = data.withColumn("digest", F.when(F.col("text").isin("c", "d"), F.lit("c" * 64)).otherwise(F.sha2("text", 256)))
    groups = named.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    assert [r.digest for r in collisions(named, groups).collect()] == ["c" * 64]


def test_tasks_send_on_whole_buckets(spark, monkeypatch):
    monkeypatch.setattr(module, "FLUSH_KEYS", 20)
    data = [(i, f"text {i % 700}") for i in range(2000)]
    batches = [b for b in docs(spark, data).select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).alias("step")).orderBy("digest").toArrow().to_batches(64)]
    sent = list(module._apply(iter(batches)))
    assert len(sent) > 20 and max(b.num_rows for b in sent) < 40
    keys = [k for b in sent for k in b.column("digest").to_pylist()]
    assert len(keys) == len(set(keys)) == 700


def test_update_query_against_sets(spark, tmp_path):
    documents = [(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c"), (6, "a")]
    docs(spark, documents).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (4, 0), (9, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(10, "b"), (11, "new"), (12, "a"), (13, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup_update(spark, str(tmp_path)).collect()}
    want = {"a": (12, 3), "b": (10, 1), "": (13, 2), "c": (5, 1), "new": (11, 1)}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live, r = CuckooIndex(2), {}, random.Random(5)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    for step in range(12_000):
        k = r.choice(keys)
        if k in live and r.random() < 0.4:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            index.insert(k, [step])
            live[k] = [step]
        assert index.live == len(live)
    assert all(index.find(k) == live.get(k) for k in keys)
    assert dict(index.items()) == live
    assert not index.delete("0" * 64)


def test_update_index(spark):
    a = build_index(docs(spark, [(1, "a"), (2, "b"), (3, "b")]))
    gone = spark.createDataFrame([(hashlib.sha256(b"b").hexdigest(),), ("f" * 64,)], "digest string")
    got = {r.digest: (r.keep_id, r.group_size) for r in update_index(a, build_index(docs(spark, [(7, "a"), (8, "c")])), gone).collect()}
    assert got == {hashlib.sha256(b"a").hexdigest(): (7, 2), hashlib.sha256(b"c").hexdigest(): (8, 1)}
