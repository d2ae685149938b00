"""Exact dense kNN over stored slices, pruned by the triangle inequality.

Vectors are assigned to the nearest of a few centroids (fitted on a bounded sample; any centroids give the same
hits) and stored in order of centroid and distance from it. Consecutive ones form a slice of bounded size: one row with ids,
vectors, its own centre and radius. No vector of a slice is nearer to a query than its centre's
distance less the radius, nor has a larger inner product than with the centre plus |query| radius.

A search reads the centres alone first; each query's most promising slice gives a k-th score, and
only slices whose bound reaches it are read. Both steps report what they read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import in_order
from tessera.operators.retrieval import DEFAULT_TOP_K, QUERY_BLOCK_BYTES, SCORE_DECIMALS, _blocks, top_k
from tessera.session import scratch_path, stored

SAMPLE_VECTORS = 4096     # vectors the centroids are fitted on, by hash order of their ids
ROUNDS = 6
SLICE_VECTORS = 512
SLACK = 10.0 ** -SCORE_DECIMALS

SLICE = "slice long, ids binary, vectors binary, centre binary, radius double"


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def centroids(vectors: DataFrame, sample: int = SAMPLE_VECTORS, rounds: int = ROUNDS) -> np.ndarray:
    """About sqrt(sample) centres by Lloyd's rounds on a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in rows])
    c = x[:max(1, int(len(x) ** 0.5))].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def build(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None,
          slice_vectors: int = SLICE_VECTORS) -> DataFrame:
    """Store ``corpus`` (long ids, vectors of one length; rows without a vector are left out) as slices; returns them."""
    spark = corpus.sparkSession
    src = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where("vector is not null")
    centres = centroids(src)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])],
                                                 names=["id", "vector", "centre", "far"])

    rows = in_order(src.mapInArrow(assign, "id long, vector array<double>, centre int, far double"), ["centre", "far", "id"])
    number = F.shiftleft(F.col("__part").cast("long"), 40) + F.floor(F.col("__pos") / slice_vectors).cast("long")

    def gather(group: pa.Table) -> pa.Table:
        x = _matrix(group["vector"].combine_chunks())
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        return pa.table({"slice": group["slice"][:1], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()),
                         "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius])})

    slices = rows.select(number.alias("slice"), "id", "vector", "centre").groupBy("slice", "centre").applyInArrow(
        lambda g: gather(g.drop_columns(["centre"])), SLICE)
    # a stretch of rows may hold the end of one centre and the start of the next: slices get their own number
    path = path or scratch_path(spark, "slices")
    slices.withColumn("slice", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """(slices, queries): no key in the slice is smaller."""
    if metric == "ip":
        return -(centre @ q.T + radius[:, None] * np.sqrt((q * q).sum(axis=1))[None, :])
    d = np.sqrt(np.maximum((centre * centre).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * centre @ q.T, 0.0))
    return np.maximum(d - radius[:, None], 0.0) ** 2


def _keys(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(rows, queries), smaller is better, rounded as scores are."""
    if metric == "ip":
        return -np.round(x @ q.T, SCORE_DECIMALS)
    return np.round(np.maximum((x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * x @ q.T, 0.0), SCORE_DECIMALS)


def _promising(slices: DataFrame, q, metric: str, wanted) -> DataFrame:
    """(slice, asked): the queries (numbers) that each slice is to be read for; ``wanted`` picks from (bounds, numbers
    of the slices) as (slice places, query numbers, bounds)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                centre = np.frombuffer(b"".join(b.column("centre").to_pylist())).reshape(b.num_rows, -1)
                at, who, bound = wanted(_bounds(q.value, centre, b.column("radius").to_numpy(), metric))
                yield pa.RecordBatch.from_arrays([b.column("slice").take(pa.array(at)), pa.array(who.astype(np.int32)), pa.array(bound)], names=["slice", "q", "bound"])

    return slices.select("slice", "centre", "radius").mapInArrow(run, "slice long, q int, bound double")


def _scored(slices: DataFrame, pairs: DataFrame, q, metric: str, k: int) -> DataFrame:
    """(q, id, key): the k best rows of each (slice, query) pair."""
    asked = pairs.groupBy("slice").agg(F.sort_array(F.collect_list("q")).alias("asked"))       # at most the queries of a block

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, who = np.frombuffer(r["ids"], "<i8"), np.array(r["asked"])
                key = _keys(q.value[who], np.frombuffer(r["vectors"]).reshape(len(ids), -1), metric)
                best = np.argsort(key, axis=0, kind="stable")[:k]            # rows are in id order, so ties go to the smaller id
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(who, len(best)).astype(np.int32)), pa.array(ids[best].ravel()),
                                                  pa.array(np.take_along_axis(key, best, 0).ravel())], names=["q", "id", "key"])

    return slices.select("slice", "ids", "vectors").join(asked, "slice").mapInArrow(run, "q int, id long, key double")


def knn(queries: DataFrame, slices: DataFrame, k: int = DEFAULT_TOP_K, metric: str = "ip", query_id: str = "qid", query_vec: str = "embedding",
        corpus_id: str = "vec_id", block_bytes: int = QUERY_BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Hits (query id, rank, corpus id, score) as ``knn_dense`` gives them, and the stored (query id, slice) that
    were read for them. The queries are a stated set, taken in blocks of bounded bytes."""
    if metric not in ("ip", "l2"):
        raise ValueError("metric must be 'ip' or 'l2'")
    spark = slices.sparkSession
    src = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv")).where("_qv is not null")
    hits = spark.createDataFrame([], f"{query_id} long, id long, key double")
    read = spark.createDataFrame([], f"{query_id} long, slice long")
    for block in _blocks(src, "_qid", F.size("_qv") * 8 + 8, block_bytes):
        rows = block.collect()
        if not rows:
            continue
        ids = spark.createDataFrame([(i, r._qid) for i, r in enumerate(rows)], f"q int, {query_id} long")
        q = spark.sparkContext.broadcast(np.array([r._qv for r in rows], np.float64))
        n = len(rows)

        def nearest(bound):
            return bound.argmin(axis=0), np.arange(bound.shape[1]), bound.min(axis=0)

        first = stored(_promising(slices, q, metric, nearest).groupBy("q").agg(F.min(F.struct("bound", "slice")).alias("f")).select("q", "f.slice"), "slice-first")
        found = stored(_scored(slices, first, q, metric, k), "slice-found")
        kth = np.full(n, np.inf)
        for r in top_k(found, "q", "key", "id", k, descending=False).where(F.col("rank") == k).select("q", "key").collect():   # one a query
            kth[r.q] = r.key
        limit = spark.sparkContext.broadcast(kth + SLACK + 1e-9 * np.abs(np.where(np.isfinite(kth), kth, 0)))

        def reaching(bound, limit=limit):
            at, who = np.nonzero(bound <= limit.value[None, :])
            return at, who, bound[at, who]

        more = stored(_promising(slices, q, metric, reaching).select("slice", "q").join(first, ["slice", "q"], "left_anti"), "slice-more")
        part = found.unionByName(_scored(slices, more, q, metric, k))
        hits = hits.unionByName(part.join(F.broadcast(ids), "q").select(query_id, "id", "key"))
        read = read.unionByName(first.select("q", "slice").unionByName(more.select("q", "slice")).join(F.broadcast(ids), "q").select(query_id, "slice"))
    best = top_k(hits, query_id, "key", "id", k, descending=False)
    score = -F.col("key") if metric == "ip" else F.col("key")
    return best.select(query_id, "rank", F.col("id").alias(corpus_id), (score + F.lit(0.0)).alias("score")), read
