"""Vector search over chunks, its diagnostics, and embedding jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import confidence, cosine, valid_vector
from lodestone.operators.centroids import centroids
from lodestone.operators.topics import few
from lodestone.sources.shared import written

#: Rows and queries of a tile, the work of one task: so many of either are held at a time.
TILE_ROWS, TILE_QUERIES = 8192, 2048
#: Where an area has more tiles than TILES, both sides of a tile grow, up to GROWTH times for vectors of 64 numbers and less for longer ones.
TILES, GROWTH = 128, 8
#: Queries scored together within a tile of TILE_ROWS; fewer in a larger one.
TOGETHER = 256
#: Where all tiles together may send so many rows of a query, they first tell how their similarities are spread, and then send what can be among the best.
BOUND_FROM = 1024
#: Conditions that a query may set on what it is answered with; null sets none.
CONDITIONS = ("year_low", "year_high", "document_type", "publication_ids")


def window_size(k: int) -> int:
    """Candidates by distance that are looked at for k results."""
    return min(max(25 * k, 100), 2000)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of length one; those without a direction become not-a-number and are near to nothing."""
    v = _matrix(column)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, np.nan)


def _allowed(rows: pa.Table, asked: pa.Table) -> list[np.ndarray | None]:
    """For each query which rows its conditions let through, None for all."""
    out: list[np.ndarray | None] = [None] * len(asked)
    values = {c: asked.column(c).to_pylist() for c in CONDITIONS if c in asked.column_names}
    year = np.array([np.nan if y is None else y for y in rows.column("year").to_pylist()]) if "year" in rows.column_names else None
    kind = np.array(rows.column("document_type").to_pylist(), object) if "document_type" in rows.column_names else None
    ids = rows.column("publication_id").to_numpy()
    tests = {"year_low": lambda v: year >= v, "year_high": lambda v: year <= v, "document_type": lambda v: kind == v, "publication_ids": lambda v: np.isin(ids, v)}
    for name, found in values.items():
        for i, v in enumerate(found):
            if v is not None:
                ok = tests[name](v)
                out[i] = ok if out[i] is None else out[i] & ok
    return out


def _scored(rows: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, its and the next ones' similarities to all rows, unit rows, unit queries); what a query does not allow is minus infinity."""
    v, q, allowed = _units(rows.column("embedding")), _units(asked.column("embedding")), _allowed(rows, asked)
    together = max(1, min(TOGETHER, TOGETHER * 8192 // max(1, len(v))))
    for a in range(0, len(q), together):
        s = np.nan_to_num(q[a : a + together] @ v.T, nan=-np.inf, neginf=-np.inf)
        for i, ok in enumerate(allowed[a : a + together]):
            if ok is not None:
                s[i, ~ok] = -np.inf
        yield a, s, v, q


def _best(keep: int, least: float | None, always: int):
    """f(rows, queries) -> the `keep` nearest rows of each query in a tile, of similarity `least` or more but for the `always` first.

    A query's `bound`, if it has one, is a similarity that `keep` rows of all tiles reach: none below it is sent.
    """

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids, chunk, pub = asked.column("query_id").to_numpy(), rows.column("chunk_id").to_numpy(), rows.column("publication_id").to_numpy()
            reached = asked.column("bound").fill_null(-np.inf).to_numpy() if "bound" in asked.column_names else np.full(len(asked), -np.inf)
            for a, s, v, q in _scored(rows, asked):
                floor = -np.inf if least is None else least - 1e-9
                kth = lambda n: np.partition(-s, n - 1, axis=1)[:, n - 1 : n] * -1 if s.shape[1] > n else np.full((len(s), 1), -np.inf)
                bound = np.maximum(kth(keep) - 1e-9, np.minimum(floor, kth(always) - 1e-9) if always else floor)
                bound = np.maximum(bound, reached[a : a + len(s), None] - 1e-9)
                i, j = np.nonzero((s >= bound) & (s > -np.inf))
                exact = np.einsum("nd,nd->n", q[a + i], v[j])  # the same sum for equal vectors, wherever they stand
                order = np.lexsort((chunk[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                ok = (place < keep) & ((exact >= (-np.inf if least is None else least)) | (place < always))
                found.append((ids[a + i[ok]], chunk[j[ok]], pub[j[ok]], exact[ok]))
        kinds = {"query_id": np.int64, "chunk_id": np.int64, "publication_id": np.int64, "similarity": np.float64}
        return pa.table({c: np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, (c, t) in enumerate(kinds.items())})

    return search


def _places(keep: int) -> np.ndarray:
    """Places in an order of `keep`, each at most a seventh beyond the one before."""
    out = [1]
    while out[-1] < keep:
        out.append(min(keep, out[-1] + max(1, out[-1] // 7)))
    return np.array(out)


def _steps(keep: int, least: float | None):
    """f(rows, queries) -> the similarities of a tile at _places(keep) of each query, as far as they reach `least`."""
    places = _places(keep)

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, found = asked.column("query_id").to_numpy(), []
        if len(rows) and len(asked):
            for _, s, _, _ in _scored(rows, asked):
                at = places[places <= s.shape[1]] - 1
                top = -np.sort(np.partition(-s, at[-1], axis=1)[:, : at[-1] + 1], axis=1)[:, at]
                found += [x[x > (-np.inf if least is None else least)] for x in top]
        else:
            ids = ids[:0]
        return pa.table({"query_id": ids, "steps": pa.array(found, pa.list_(pa.float64()))})

    return search


def _bounded(rows: DataFrame, asked: DataFrame, cuts: DataFrame, keep: int, least: float | None) -> DataFrame:
    """asked with a bound: a similarity that at least `keep` rows reach; null where there are not so many."""
    told = tiles(rows, asked, _steps(keep, least), "query_id long, steps array<double>", cuts).filter(F.size("steps") > 0).repartition("query_id")
    places = _places(keep)
    more = F.array(*(F.lit(int(x)) for x in np.diff(places, prepend=0)))
    # A tile has as many rows of a similarity as the place of its last step there says: steps of all tiles add up.
    each = told.select("query_id", F.explode(F.arrays_zip("steps", F.slice(more, F.lit(1), F.size("steps")).alias("more"))).alias("z")).select("query_id", F.col("z.steps").alias("at"), F.col("z.more").alias("more"))
    run = each.withColumn("n", F.sum("more").over(Window.partitionBy("query_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)))
    bounds = written(run.filter(F.col("n") >= keep).groupBy("query_id").agg(F.max("at").alias("bound")), "bounds")
    return written(asked.join(bounds, "query_id", "left"), "asked")


def cuts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(area, parts, blocks): in how many parts an area's rows and queries are cut. Areas that only one side has are left out.

    A part has about TILE_ROWS rows and a block TILE_QUERIES queries, more where there would be more than TILES tiles.
    """
    counts = rows.groupBy("area").agg(F.count(F.lit(1)).alias("r"), F.max(F.size("embedding")).alias("d")).join(asked.groupBy("area").agg(F.count(F.lit(1)).alias("q")), "area")
    parts, blocks = F.col("r") / TILE_ROWS, F.col("q") / TILE_QUERIES
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(GROWTH)), GROWTH * 64 / F.greatest(F.col("d"), F.lit(1))))
    grown = F.greatest(F.lit(1.0), F.least(most, F.sqrt(F.ceil(parts) * F.ceil(blocks) / TILES)))
    return few(written(counts.select("area", F.ceil(parts / grown).cast("int").alias("_parts"), F.ceil(blocks / grown).cast("int").alias("_blocks")), "cuts"))


def tiles(rows: DataFrame, asked: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, cuts: DataFrame | None = None) -> DataFrame:
    """search over every tile: some rows of an area against some queries of it. Both sides name their area (int).

    An area's rows and queries are cut by hash (see cuts_of); each part of the one side is sent to the tiles of the other's
    parts. Areas that only one side has cost nothing.
    """
    n = cuts_of(rows, asked) if cuts is None else cuts

    def dealt(df: DataFrame, key: str, own: str, other: str, at: str, over: str) -> DataFrame:
        placed = df.join(F.broadcast(n), "area").withColumn(at, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return placed.withColumn(over, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_parts", "_blocks")

    tile = ["area", "_part", "_block"]
    left = dealt(rows, "chunk_id", "_parts", "_blocks", "_part", "_block").groupBy(*tile)
    return left.cogroup(dealt(asked, "query_id", "_blocks", "_parts", "_block", "_part").groupBy(*tile)).applyInArrow(search, schema)


def _sides(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with vectors, written; with the conditions that queries set, and by year where they set years.

    Rows of a year are an area, so a query meets only its years' rows; those without a year meet queries that set none.
    """
    set_here = [c for c in CONDITIONS if c in queries.columns]
    by_year = "year_low" in set_here or "year_high" in set_here
    told = [c for c, of in (("year", ("year_low", "year_high")), ("document_type", ("document_type",))) if set(of) & set(set_here)]
    area = F.coalesce(F.col("year").cast("int"), F.lit(-1)) if by_year else F.lit(0)
    rows = chunks.filter(F.col("embedding").isNotNull()).select(area.alias("area"), "chunk_id", F.col("publication_id").cast("long").alias("publication_id"), "embedding", *told)
    rows = written(rows, "rows")
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding", *set_here)
    if not by_year:
        return rows, written(asked.withColumn("area", F.lit(0)), "asked")
    low, high = (F.col(c) if c in set_here else F.lit(None).cast("int") for c in ("year_low", "year_high"))
    inside = (low.isNull() & high.isNull()) | ((F.col("area") >= 0) & F.coalesce(F.col("area") >= low, F.lit(True)) & F.coalesce(F.col("area") <= high, F.lit(True)))
    return rows, written(asked.join(F.broadcast(few(rows.select("area").distinct())), inside), "asked")


def candidates(chunks: DataFrame, queries: DataFrame, keep: int, least: float | None = None, always: int = 0) -> DataFrame:
    """(query_id, chunk_id, publication_id, similarity): the `keep` nearest chunks of each query, exact, ties by chunk.

    With least, only those of that similarity or more, and the `always` nearest. Queries may set conditions
    (year_low, year_high, document_type, publication_ids), which hold before the nearest are taken. Tiles
    keep their best, and the rest are ranked by query. Where those are many, rows are scored twice, so that
    about `keep` of a query are sent by all tiles together and not by each of them.
    """
    rows, asked = _sides(chunks, queries)
    cuts = cuts_of(rows, asked)
    if not cuts.filter((F.col("_parts") > 1) & (F.col("_parts") * keep >= BOUND_FROM)).isEmpty():
        asked = _bounded(rows, asked, cuts, keep, least)
    return ranked(tiles(rows, asked, _best(keep, least, always), "query_id long, chunk_id long, publication_id long, similarity double", cuts), keep, least, always)


def ranked(found: DataFrame, keep: int, least: float | None = None, always: int = 0) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    near = found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep)
    return (near if least is None else near.filter((F.col("similarity") >= least) | (F.col("_rank") <= always))).drop("_rank")


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 8, threshold: float = 0.48) -> DataFrame:
    """The k best publications of each query: gate (inclusive), best chunk of a publication, then rank. Queries may set conditions (see candidates)."""
    if not 1 <= k <= 50 or not 0 <= threshold <= 1:
        raise ValueError("k must be within 1 to 50 and the threshold within 0 to 1")
    # The k best publications have their best chunks among this many: each may have all its chunks before the next one's best.
    most = chunks.filter(F.col("embedding").isNotNull()).groupBy("publication_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return publications_of(candidates(chunks, queries, min(window_size(k), k * most), threshold), k)


def publications_of(near: DataFrame, k: int) -> DataFrame:
    """The k best publications of each query, by the best chunk of each."""
    by_pub = Window.partitionBy("query_id", "publication_id").orderBy(F.desc("similarity"), "chunk_id")
    one = near.withColumn("_r", F.row_number().over(by_pub)).filter("_r = 1").drop("_r")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("similarity", F.round("similarity", 4))


def diagnostics(chunks: DataFrame, queries: DataFrame, k: int = 8, threshold: float = 0.48) -> DataFrame:
    """One row for each query: candidates, rows after the gate, publications, best similarity, its distance to the gate, verdict."""
    near = candidates(chunks, queries, window_size(k), threshold, always=1)
    gate = F.col("similarity") >= threshold
    stats = near.groupBy("query_id").agg(F.count_if(gate).alias("gated_rows"), F.countDistinct(F.when(gate, F.col("publication_id"))).alias("publications"), F.max("similarity").alias("top"))
    seen = chunks.filter(F.col("embedding").isNotNull()).agg(F.least(F.count(F.lit(1)), F.lit(window_size(k))).alias("window"))
    zero = F.lit(0)
    verdict = F.when(F.col("top").isNull(), "no_candidates").when(F.col("gated_rows") > 0, "hit").otherwise("below_vector_threshold")
    every = queries.select("query_id").join(stats, "query_id", "left").crossJoin(F.broadcast(seen))
    return every.select("query_id", F.when(F.col("top").isNull(), zero).otherwise(F.col("window")).alias("candidate_rows"), F.coalesce("gated_rows", zero).alias("gated_rows"), F.coalesce("publications", zero).alias("publications"), F.round("top", 4).alias("top_similarity"), F.round(F.col("top") - threshold, 4).alias("margin"), verdict.alias("verdict"))


def nearest_centroid(queries: DataFrame, centers: DataFrame) -> DataFrame:
    """The nearest group of each query; centers are few (one a topic) and their number is checked."""
    if centers.limit(10_001).count() > 10_000:
        raise ValueError("too many centroids to send to every task; search them with vector_search")
    pairs = queries.crossJoin(F.broadcast(centers)).select("query_id", "grp", cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("grp", "s"), F.struct("s", -F.col("grp"))).alias("b"))
    return best.select("query_id", F.col("b.grp").alias("topic"), F.round("b.s", 4).alias("similarity"))


#: Steps in which similarities are counted, over -1 to 1.
STEPS = 1 << 16


def _counted(cut: float, wanted: dict[bool, list[tuple[int, int]]] | None):
    """f(rows, queries) -> counts of similarities by step for pairs of the same publication and others; with wanted, by value within those steps.

    Pairs of a query and its own chunk are left out. Without wanted: step -1 has the pairs of similarity `cut` or more, and best the greatest.
    """

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        same, step, value, n = [], [], [], []
        if len(rows) and len(asked):
            ids, own = asked.column("query_id").to_numpy(), asked.column("own").to_numpy()
            chunk, pub = rows.column("chunk_id").to_numpy(), rows.column("publication_id").to_numpy()
            for a, s, v, q in _scored(rows, asked):
                use = s > -np.inf
                s = np.einsum("nd,md->nm", q[a : a + len(s)], v)  # the same sum in either pass, wherever rows stand
                use = use & ~np.isnan(s) & (ids[a : a + len(s), None] != chunk[None, :])
                alike = own[a : a + len(s), None] == pub[None, :]
                for flag in (False, True):
                    x = np.round(s[use & (alike == flag)], 12)
                    at = np.clip(((x + 1) / 2 * STEPS).astype(np.int64), 0, STEPS - 1)
                    if wanted is not None:
                        inside = np.isin(at, np.array(wanted.get(flag, []), np.int64))
                        v_, c = np.unique(x[inside], return_counts=True)
                        a_ = np.clip(((v_ + 1) / 2 * STEPS).astype(np.int64), 0, STEPS - 1)
                    elif len(x):
                        a_, c = np.unique(at, return_counts=True)
                        a_, c, v_ = np.append(a_, -1), np.append(c, (x >= cut).sum()), np.append(np.full(len(a_), np.nan), x.max())
                    else:
                        continue
                    same, step, value, n = [*same, np.full(len(a_), flag)], [*step, a_], [*value, v_], [*n, c]
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table({"same_publication": join(same, bool), "step": join(step, np.int64), "value": join(value, np.float64), "n": join(n, np.int64)})

    return search


def similarity_distribution(chunks: DataFrame, queries: DataFrame, cut: float = 0.48) -> DataFrame:
    """Spread of similarities (12 decimals) between the queries and all other chunks, for the same publication and others.

    Pairs are counted by steps within tiles, so a task sends STEPS counts at most; a second pass over the tiles counts
    values within the steps that hold a quantile. The quantiles are exact.
    """
    rows, asked = _sides(chunks, queries.select("query_id", "embedding"))
    asked = written(asked.join(queries.select("query_id", F.col("publication_id").cast("long").alias("own")), "query_id"), "asked")
    schema = "same_publication boolean, step long, value double, n long"
    first = written(tiles(rows, asked, _counted(cut, None), schema).groupBy("same_publication", "step").agg(F.sum("n").alias("n"), F.max("value").alias("value")), "steps")
    by = Window.partitionBy("same_publication").orderBy("step")  # STEPS rows at most
    steps = first.filter("step >= 0").select("same_publication", "step", (F.sum("n").over(by) - F.col("n")).alias("before"), "n", F.sum("n").over(Window.partitionBy("same_publication")).alias("total"))
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p"), e(F.lit(p) * (F.col("total") - 1)).alias("place"), F.lit(side).alias("side")) for k, p in shares.items() for side, e in (("lo", F.floor), ("hi", F.ceil)))))
    held = written(steps.select("same_publication", "step", "before", "n", "total", places.alias("q")).filter("q.place >= before and q.place < before + n").select("same_publication", "step", "before", "total", "q.*"), "held")
    wanted: dict[bool, list[int]] = {}
    for r in held.select("same_publication", "step").distinct().collect():  # twelve rows at most
        wanted.setdefault(r.same_publication, []).append(r.step)
    second = tiles(rows, asked, _counted(cut, wanted), schema).groupBy("same_publication", "step", "value").agg(F.sum("n").alias("n"))
    run = second.withColumn("below", F.sum("n").over(Window.partitionBy("same_publication", "step").orderBy("value")) - F.col("n"))
    hit = run.join(F.broadcast(held), ["same_publication", "step"]).filter("place >= before + below and place < before + below + n")
    value = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))
    part = lambda p: F.lit(p) * (F.max("total") - 1) - F.floor(F.lit(p) * (F.max("total") - 1))
    quantiles = hit.groupBy("same_publication").agg(F.max("total").alias("pairs"), *(F.round(value(k, "lo") + (value(k, "hi") - value(k, "lo")) * part(p), 4).alias(k) for k, p in shares.items()))
    rest = first.filter("step = -1").select("same_publication", F.round("value", 4).alias("greatest"), F.col("n").alias("_above"))
    return quantiles.join(rest, "same_publication").withColumn("share_above", F.round(F.col("_above") / F.col("pairs"), 6)).drop("_above")


def pending(chunks: DataFrame, done: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Chunks without an embedding among `done` (all with force), by id; at most `limit`."""
    rows = chunks if force else chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def embedding_text(title, abstract):
    return F.trim(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit(""))))


def embed_chunks(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, version: str, size: int, text: str = "chunk_text") -> DataFrame:
    """chunk_id, embedding and its stamps. encoder() loads the model once for each task; wrong vectors are marked not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            vectors = encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    out = chunks.select(F.col("chunk_id").cast("long"), F.col(text)).mapInArrow(run, "chunk_id long, embedding array<float>")
    return out.withColumns({"embedding_model": F.lit(model), "embedding_version": F.lit(version), "embedding_dimension": F.size("embedding"), "valid": valid_vector(F.col("embedding"), size)})


def hashing_encoder(size: int) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A stand-in encoder: signed counts of hashed words."""

    def load():
        import zlib

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * size
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1.0 if h >> 31 else -1.0
                out.append(v)
            return out

        return encode

    return load


def mixed_versions(stored: DataFrame, model: str, version: str) -> DataFrame:
    """Distinct (model, version) in store that differ from this run's."""
    return stored.select("embedding_model", "embedding_version").distinct().filter((F.col("embedding_model") != model) | (F.col("embedding_version") != version))


#: Areas over which buckets are dealt by hash; those of one area are told apart by their keys.
AREAS = 1 << 16


def _near_in_buckets(k: int, least: float):
    """f(rows, queries) -> in a tile, the k best publications of each query, by their best chunk of similarity `least` or more in the query's bucket."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids, chunk, pub = asked.column("query_id").to_numpy(), rows.column("chunk_id").to_numpy(), rows.column("publication_id").to_numpy()
            bucket, own = rows.column("bucket").to_numpy(), asked.column("bucket").to_numpy()
            for a, s, v, q in _scored(rows, asked):
                i, j = np.nonzero((s >= least - 1e-9) & (own[a : a + len(s), None] == bucket[None, :]))
                exact = np.einsum("nd,nd->n", q[a + i], v[j])  # the same sum for equal vectors, wherever they stand
                order = np.lexsort((chunk[j], -exact, i))
                order = order[exact[order] >= least]
                i, j, exact = i[order], j[order], exact[order]
                first = np.sort(np.unique(np.stack([i, pub[j]], axis=1), axis=0, return_index=True)[1])
                i, j, exact = i[first], j[first], exact[first]
                ok = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((ids[a + i[ok]], chunk[j[ok]], pub[j[ok]], exact[ok]))
        kinds = {"query_id": np.int64, "chunk_id": np.int64, "publication_id": np.int64, "similarity": np.float64}
        return pa.table({c: np.concatenate([np.zeros(0, t), *(f[n] for f in found)]) for n, (c, t) in enumerate(kinds.items())})

    return search


def lsh_search(chunks: DataFrame, queries: DataFrame, k: int = 8, threshold: float = 0.48, width: float = 0.6, tables: int = 8) -> DataFrame:
    """vector_search by random projections: only chunks that share a bucket are scored, then ranked exactly. Recall is measured by evaluate.recall.

    Buckets of each table are cut in tiles; a tile sends the k best publications of a query at most, no pairs.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df: DataFrame, *cols: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        # Written, as the vector functions fail on rows that a filter in the same stage drops.
        some = df.filter(F.col("embedding").isNotNull()).withColumn("_n", norm).filter("_n > 0")
        some = written(some.select(*cols, "embedding", F.transform("embedding", lambda x: x / F.col("_n")).alias("unit")), "units")
        return some.select(*cols, "embedding", array_to_vector("unit").alias("v"))

    c = unit(chunks.withColumn("publication_id", F.col("publication_id").cast("long")), "chunk_id", "publication_id")
    q = unit(queries, "query_id")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(c)

    def dealt(df: DataFrame, label: str) -> DataFrame:
        keys = F.transform("h", lambda x, t: F.xxhash64(t, x))
        hashed = model.transform(df).withColumn("h", F.array(*(vector_to_array(F.col("h")[t])[0] for t in range(tables))))
        rows = hashed.select("*", F.explode(keys).alias("bucket")).drop("v", "h")
        return written(rows.withColumn("area", F.pmod("bucket", F.lit(AREAS)).cast("int")), label)

    near = tiles(dealt(c, "rows"), dealt(q, "asked"), _near_in_buckets(k, threshold), "query_id long, chunk_id long, publication_id long, similarity double")
    return publications_of(near, k)


def build_cells(chunks: DataFrame, cells: int, path: str, sample: int = 100_000, seed: int = 7) -> np.ndarray:
    """Write all chunks with vectors to path, a Parquet partition for each k-means cell of their directions; the cells' centres.

    The centres are fitted on about `sample` rows, chosen by hash; every row is written, once, to its nearest
    centre's partition. The centres, cells times the vectors' length, are the only thing that is held.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = chunks.filter(F.col("embedding").isNotNull()).withColumn("_n", norm).filter("_n > 0").drop("_n")
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(max(n, 1))) < sample).withColumn("_n", norm)
    some = written(some.select(F.transform("embedding", lambda x: x / F.col("_n")).alias("unit")), "units").select(array_to_vector("unit").alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed).fit(some).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    placed = rows.withColumn("cell", nearest_cells(F.col("embedding"), centres, 1)[0])
    placed.write.partitionBy("cell").parquet(path)
    return centres


def nearest_cells(embedding, centres: np.ndarray, probes: int):
    """The `probes` nearest cells of each vector, nearest first."""

    @F.pandas_udf("array<int>")
    def cells(v):
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, centres.shape[1]))
        order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        return type(v)(list(order))

    return cells(embedding)


def cell_search(cells: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 8, threshold: float = 0.48, probes: int = 4) -> DataFrame:
    """vector_search over the chunks of each query's `probes` nearest cells alone, as build_cells wrote them; no other partition is read.

    Approximate: a chunk in another cell is missed. evaluate.recall measures it.
    """
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    asked = written(asked.select("query_id", "embedding", F.explode(nearest_cells(F.col("embedding"), centres, probes)).alias("area")), "asked")
    rows = cells.select(F.col("cell").cast("int").alias("area"), "chunk_id", F.col("publication_id").cast("long").alias("publication_id"), "embedding")
    rows = rows.join(F.broadcast(few(asked.select("area").distinct())), "area", "left_semi")
    near = tiles(rows, asked, _best(window_size(k), threshold, 0), "query_id long, chunk_id long, publication_id long, similarity double")
    return publications_of(ranked(near, window_size(k), threshold), k)


def evidence_of_matches(matches: DataFrame) -> DataFrame:
    return matches.withColumn("confidence", confidence(F.col("similarity")))
