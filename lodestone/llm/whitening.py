"""Embedding whitening: principal components by QDWH spectral divide-and-conquer, applied to every row.

Spark makes the exact sums, the covariance and the projections; each is a sum over all rows in which a task
sends d or d*d numbers, d being the length of the vectors. The decomposition works on one d*d matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.vectors import finite_vectors, matrix

#: Entries are counted in steps of 1 / SCALE from SHIFT; beyond FAR an entry's count is no whole double.
SCALE, SHIFT, FAR = 1024, 100_000, float(1 << 42)
#: Components with less than this share of the greatest variance (times d) are not told from rounding.
LEAST = 1e-13
LONG = (1 << 63) - 1


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: dynamically weighted Halley steps, each by QR, at most a dozen."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / np.sqrt(n)  # no singular value that matters lies below
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (weight + b * low**2) / (1 + c * low**2))
        moved, x = np.linalg.norm(new - x), new
        if abs(low - 1) < 1e-15 and moved < 1e-9:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(Q, k): orthonormal columns, the first k spanning the eigenvectors above a shift; None if a is a multiple of the identity.

    The shift is tried between the middle diagonal entries, then at the mean and beside it, until the polar
    factor of the shifted matrix is a reflection with eigenvectors on either side.
    """
    n, diagonal = len(a), np.sort(np.diag(a))
    mean = diagonal.mean()
    width = np.linalg.norm(a - mean * np.eye(n))
    if width <= 4 * np.finfo(float).eps * np.linalg.norm(a):
        return None
    middle = (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2
    rng = np.random.default_rng(n)
    for shift in [middle, *(mean + width * f / n for f in (0, 0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.01, -0.01))]:
        u = polar(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if 0 < k < n and np.linalg.norm(projector @ projector - projector) < 1e-10:
            q = np.linalg.qr(projector @ rng.standard_normal((n, k)), mode="complete")[0]
            return np.linalg.qr(projector @ q[:, :k], mode="complete")[0], k
    return None


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Invariant subspaces are split until one vector is left in each, or a matrix that is a multiple of the
    identity. Rounding is then taken out by one first-order correction where values are apart.
    """
    todo, done = [(a, np.eye(len(a)))], []
    while todo:
        part, basis = todo.pop()
        found = split(part) if len(part) > 1 else None
        if found is None:
            done.append(basis)
            continue
        q, k = found
        for side in (q[:, :k], q[:, k:]):
            inner = side.T @ part @ side
            todo.append(((inner + inner.T) / 2, basis @ side))
    v = np.hstack(done)
    e = v.T @ a @ v
    values = np.diag(e)
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > 1e-6 * np.abs(values).max()
    v = v + v @ np.where(far, e / np.where(far, apart, 1), 0)
    v = v @ (3 * np.eye(len(a)) - v.T @ v) / 2
    values = np.einsum("ij,ik,kj->j", v, a, v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def counts(column) -> np.ndarray:
    """The entries as whole numbers: floor(SCALE * entry) + SHIFT."""
    return (np.floor(matrix(column) * SCALE) + SHIFT).astype(np.int64)


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension's counts), exact: each task sends d sums of high and low halves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = counts(batch.column("vector"))
                n, total = n + len(x), [t + int(h) * (1 << 20) + int(w) for t, h, w in zip(total, (x >> 20).sum(0), (x & 0xFFFFF).sum(0), strict=True)]
        yield pa.record_batch({"at": pa.array(range(-1, d), pa.int32()), "s": pa.array([str(v) for v in (n, *total)])})

    out = vectors.select("vector").mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in out.collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def gram(rows: DataFrame, column: str, centred, d: int) -> np.ndarray:
    """Sum over all rows of the outer products of centred(column), d by d; each task sends one matrix, added up by row and column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                z = centred(batch.column(column))
                total += z.T @ z
        yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(column).mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # d * d rows
        out[r.i, r.j] = r.x
    return (out + out.T) / 2


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error): a row for each vector that takes part.

    whitened[c] is the row's centred vector on component c over the root of that component's variance.
    deviation is exact, null if it exceeds a long. Components are at most `components`, fewer where vectors are
    shorter; one without variance (a single row, equal rows, a dimension that depends on others) cannot be
    whitened and is left out. Rows whose vector is null, empty or holds null or non-finite entries are dropped, as
    are vectors with an entry beyond 2^42 or of another length than the most common. A null id stays as it is
    and repeated rows each count. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    near = F.forall("vector", lambda c: F.abs(c) < FAR)
    vectors = finite_vectors(df, id_col, vector_col).filter(near)
    head = vectors.select(F.size("vector").alias("d")).first()
    d = head.d if head else 0
    n, total = sums(vectors, d) if d else (0, [])
    kind = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not n:
        return df.sparkSession.createDataFrame([], kind)
    exact = n * int(FAR) * SCALE * 4 < LONG
    middle = np.array(total, object)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n * x - S, in long where it fits."""
        far = n * (int(np.abs(x).max()) + int(max(abs(t) for t in total) // n) + 2)
        return n * x - np.array(total, np.int64) if exact or far < LONG and all(abs(t) < LONG for t in total) else n * x.astype(object) - middle

    def centred(column) -> np.ndarray:
        return deviations(counts(column)).astype(np.float64) / n

    values, vectors_of = eigenvectors(gram(vectors, "vector", centred, d) / n)
    trace = float(values.sum())
    kept = [c for c in range(min(components, d)) if values[c] > LEAST * d * max(values[0], 0)]
    if not kept:
        return df.sparkSession.createDataFrame([], kind)
    turn = vectors_of[:, kept] / np.sqrt(values[kept])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = deviations(counts(batch.column("vector")))
            fits = z.dtype != object and int(np.abs(z).max()) ** 2 * d < LONG
            squares = (z * z).sum(1).tolist() if fits else [sum(int(v) ** 2 for v in row) for row in z]
            w = np.einsum("rd,dk->rk", z.astype(np.float64) / n, turn)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "deviation": pa.array([s if s <= LONG else None for s in squares], pa.int64()), "whitened": pa.array(list(w), pa.list_(pa.float64()))})

    out = written(vectors.mapInArrow(project, "vec_id long, deviation long, whitened array<double>"), "whitened")
    k = len(kept)
    means = out.agg(*(F.avg(F.col("whitened")[c]).alias(f"m{c}") for c in range(k))).first()
    off = np.array([means[c] for c in range(k)])
    error = float(np.abs(gram(out, "whitened", lambda column: matrix(column) - off, k) / n - np.eye(k)).max())
    explained = F.array(*(F.lit(float(values[c]) / trace) for c in kept))
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
