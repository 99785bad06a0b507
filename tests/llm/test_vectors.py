"""Whitening against a plain solver, nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hnsw, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int, rep string, vector int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2, 0.5) for i, v in rows], VECTORS)


def drawn(n, d, seed=3):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate((r.standard_normal((n, d)) * np.linspace(3, 1, d)).astype(np.float32))]


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0, 1.0, 0.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0])]


def test_eigenvectors_by_divide_and_conquer():
    r = np.random.default_rng(1)
    wide, low = r.standard_normal((40, 40)), r.standard_normal((30, 6))
    for a in (wide @ wide.T, low @ low.T, np.eye(5), np.zeros((3, 3)), np.diag([3.0, 3, 1, 1, 0]), np.diag([1e12, 1.0, 1e-6]), np.array([[2.0]])):
        values, v = whitening.eigenvectors(a)
        size = max(np.abs(a).max(), 1e-300)
        assert (np.diff(values) <= 1e-12 * size).all()
        assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-12
        assert np.abs(v @ np.diag(values) @ v.T - a).max() < 1e-12 * len(a) * size
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * len(a) * size


def expected_whitening(rows, k=8):
    x = np.array([[math.floor(float(np.float32(c)) * 1024) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    z = ((n * x - s) / n).astype(float)
    cov = z.T @ z / n
    values, v = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return [int(((n * r - s) ** 2).sum()) for r in x], z @ v[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def test_whitening_against_a_plain_solver(spark):
    rows = drawn(300, 6)
    got = sorted(whitening.whiten(vectors(spark, rows + ODD).repartition(5)).collect(), key=lambda r: r.vec_id)
    deviation, white, share = expected_whitening(rows)
    assert [r.vec_id for r in got] == [i for i, _ in rows]
    assert [r.deviation for r in got] == deviation
    w = np.array([r.whitened for r in got])
    signs = np.sign((w * white).sum(0))
    assert np.abs(w * signs - white).max() < 1e-9
    assert np.abs(np.array(got[0].explained) - share).max() < 1e-12
    assert {r.n for r in got} == {300} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, ODD[:2])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect() == []  # no variance
    flat = [(i, [v[0], v[1], 7.0]) for i, v in drawn(50, 3)]
    assert {len(r.whitened) for r in whitening.whiten(vectors(spark, flat)).collect()} == {2}
    again = [*drawn(40, 3), *drawn(40, 3), (None, [1.0, 2.0, 3.0])]
    assert len(whitening.whiten(vectors(spark, again)).collect()) == 81
    large = [(i, [c * 1e3 for c in v]) for i, v in drawn(40, 3)]
    assert {r.deviation for r in whitening.whiten(vectors(spark, large)).collect()} == set(expected_whitening(large)[0])
    huge = [(i, [c * 1e6 for c in v]) for i, v in drawn(40, 3)]  # beyond a long
    assert {r.deviation for r in whitening.whiten(vectors(spark, huge)).collect()} == {None} and min(expected_whitening(huge)[0]) > 2**63
    assert len(whitening.whiten(vectors(spark, [*huge, (99, [1e30, 1.0, 1.0])])).collect()) == 40


def exact(rows, asked, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}

    def total(a):
        return float(np.add.accumulate(a)[-1])

    norm = {i: math.sqrt(total(v * v)) for i, v in x.items()}
    return {q: sorted((-total(x[q] * x[i]) / (norm[q] * norm[i]), i) for i in x if i != q)[:k] for q in x if asked(q)}


def as_found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((-r.score, r.vec_id))
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rows = drawn(400, 6)
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000 + i, [2 * c for c in rows[9][1]]) for i in range(9)]  # a hot vector, and a scaled one
    table = vectors(spark, rows + ODD + [(950, [0.0] * 6), rows[3], (None, rows[4][1])])
    got = as_found(hnsw.nearest(table.repartition(6), F.col("vec_id") % 10 == 0, k=5, shard_rows=128))
    assert got == exact(rows, lambda i: i % 10 == 0, 5)


def test_few_or_no_candidates(spark):
    assert hnsw.nearest(vectors(spark, []), F.lit(True)).collect() == []
    assert hnsw.nearest(vectors(spark, [(50, [1.0, 2.0])]), F.lit(True)).collect() == []
    three = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])]
    got = as_found(hnsw.nearest(vectors(spark, three), F.col("vec_id") % 50 == 0))
    assert got == exact(three, lambda i: i % 50 == 0, 5) and {len(v) for v in got.values()} == {2}


@pytest.mark.parametrize("d", [24])
def test_recall_at_the_registered_parameters(d):
    import pyarrow as pa

    x = np.random.default_rng(5).standard_normal((4000, d))
    ids = np.arange(len(x))
    index = hnsw.index_shard(pa.table({"rep": ids, "vector": pa.array(list(x), pa.list_(pa.float64())), "shard": pa.array([0] * len(x), pa.int32())}))
    asked = ids[::50]
    found = hnsw.search_shard(6, hnsw.EF_SEARCH)(index, pa.table({"query_id": asked, "vector": pa.array(list(x[asked]), pa.list_(pa.float64()))}))
    u = hnsw.unit_of(x)
    best = np.argsort(-(u[asked] @ u.T), axis=1)[:, :6]
    got = set(zip(found["query_id"].to_pylist(), found["rep"].to_pylist(), strict=True))
    assert sum((q, i) in got for q, row in zip(asked, best, strict=True) for i in row) / best.size >= 0.95
    neighbours = [np.array(v) for v in index["neighbours"].to_pylist()]
    assert len(neighbours[0]) == len(x) * 2 * hnsw.DEGREE and all((v < n // w).all() for v, n, w in ((v, len(v), hnsw.DEGREE * (2 if not k else 1)) for k, v in enumerate(neighbours)))


def test_registered_recall(spark):
    folder = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact([(r.vec_id, r.embedding) for r in t], lambda i: i % 50 == 0, 5)
    got = as_found(queries.op13_nearest_neighbours(spark, folder))
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * sum(len(v) for v in want.values())
