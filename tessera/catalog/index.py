"""Registered queries over stored indexes: pruned dense search, and an index that follows its documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import CHUNKS, KNN_SPARSE_HITS
from tessera.operators import inverted as I
from tessera.operators import retrieval as R
from tessera.operators import slices as S
from tessera.session import scratch_path, table
from tessera.sources import index_store as IX

ASKED_EVERY = 100      # queries: the vectors whose id it divides


def _pruned_sql(score: str, order: str) -> str:
    return f"""WITH _e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
_q AS (SELECT vec_id AS query_id, e AS q FROM _e WHERE vec_id % {ASKED_EVERY} = 0),
_s AS (SELECT query_id, vec_id, round({score}, 6) AS score FROM _q, _e),
_r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS INTEGER) AS rank, vec_id, score FROM _s)
SELECT query_id, rank, vec_id, score FROM _r WHERE rank <= 5"""


def _pruned(spark, sf, metric):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % ASKED_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return S.knn(asked, S.build(vectors), k=5, metric=metric, query_id="query_id")[0]


@register("knn_ip_pruned", _pruned_sql("list_inner_product(e, q)", "DESC"))
def q_knn_ip_pruned(spark, sf):
    return _pruned(spark, sf, "ip")


@register("knn_l2_pruned", _pruned_sql("list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - q[i]) * (e[i] - q[i])))", "ASC"))
def q_knn_l2_pruned(spark, sf):
    return _pruned(spark, sf, "l2")


@register("knn_sparse_index", f"WITH {KNN_SPARSE_HITS} SELECT item_id, rank, chunk_id, score FROM hits")
def q_knn_sparse_index(spark, sf):
    """As knn_sparse, from stored postings: the index is built, stored, loaded and searched."""
    path = scratch_path(spark, "sparse-index")
    I.build(R.build_chunks(table(spark, sf, "documents")), path)
    return I.knn(table(spark, sf, "benchmark"), I.load(spark, path))[0]


@register("update_index", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_text FROM chunks")
def q_update_index(spark, sf):
    """The documents as they were before (some missing, some with an older text, and the benchmark items beside
    them), then as they are: the second update chunks only what differs."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    gone = table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000_000).alias("doc_id"), F.lit("benchmark").alias("source"), "text")
    older = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text"))
    root = scratch_path(spark, "followed-index")
    IX.update(spark, root, docs.where("doc_id % 97 <> 1").withColumn("text", older).unionByName(gone))
    IX.update(spark, root, docs)
    return IX.read(spark, root).select("doc_id", "chunk_no", "chunk_text")
