"""Registered retrieval queries (index build, sparse/dense kNN, context)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import CHUNKS, KNN_SPARSE_HITS, RAG_CONTEXT
from tessera.functions import text as T
from tessera.plans.rag import retrieve_with_context
from tessera.operators import retrieval as R
from tessera.session import table


def _chunks(spark, sf):
    return R.build_chunks(table(spark, sf, "documents"))


@register("chunk_text", f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no, chunk_text FROM chunks")
def q_chunk_text(spark, sf):
    return _chunks(spark, sf).select("chunk_id", "doc_id", "chunk_no", "chunk_text")


@register("assign_chunk_ids", f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no FROM chunks")
def q_assign_chunk_ids(spark, sf):
    return _chunks(spark, sf).select("chunk_id", "doc_id", "chunk_no")


@register("knn_sparse", f"WITH {KNN_SPARSE_HITS} SELECT item_id, rank, chunk_id, score FROM hits")
def q_knn_sparse(spark, sf):
    return R.knn_sparse(table(spark, sf, "benchmark"), _chunks(spark, sf), k=R.RAG_TOP_K)


# ------------------------------------------------------------ hits and context

@register("topk_global", f"""WITH {KNN_SPARSE_HITS.replace("WHERE rank <= 3", "WHERE rank <= 5")}
SELECT item_id, rank, chunk_id, score FROM hits""")
def q_topk_global(spark, sf):
    return R.knn_sparse(table(spark, sf, "benchmark"), _chunks(spark, sf), k=R.DEFAULT_TOP_K)


def _hits(spark, sf):
    chunks = _chunks(spark, sf)
    return R.knn_sparse(table(spark, sf, "benchmark"), chunks, k=R.RAG_TOP_K), chunks


@register("lookup_chunk_text", f"""WITH {KNN_SPARSE_HITS}
SELECT h.item_id, h.rank, h.chunk_id, c.chunk_text FROM hits h LEFT JOIN chunks c ON h.chunk_id = c.chunk_id""")
def q_lookup_chunk_text(spark, sf):
    hits, chunks = _hits(spark, sf)
    return R.lookup_text(hits, chunks).select("item_id", "rank", "chunk_id", "chunk_text")


@register("rank_hits", f"""WITH {KNN_SPARSE_HITS}
SELECT h.item_id, h.rank, h.chunk_id, h.score,
       CASE WHEN length(c.chunk_text) > 200 THEN substring(c.chunk_text, 1, 200) || '...' ELSE c.chunk_text END AS preview
FROM hits h LEFT JOIN chunks c ON h.chunk_id = c.chunk_id""")
def q_rank_hits(spark, sf):
    hits, chunks = _hits(spark, sf)
    return R.lookup_text(hits, chunks).select("item_id", "rank", "chunk_id", "score",
                                              T.preview("chunk_text").alias("preview"))


# Nation names share no word with the corpus: their neighbours are all absent.
_ASKED_SQL = """asked AS (SELECT item_id, text FROM benchmark
           UNION ALL SELECT 1000000 + CAST(n_nationkey AS BIGINT) AS item_id, n_name AS text FROM nation)"""


@register("drop_missing_hits", f"""WITH {_ASKED_SQL},
{KNN_SPARSE_HITS.replace("WHERE rank <= 3", "WHERE rank <= 5").replace("FROM benchmark", "FROM asked")},
_grid AS (SELECT b.item_id, CAST(r AS INTEGER) AS rank FROM asked b, range(1, 6) t(r)),
_pad AS (SELECT g.item_id, g.rank, coalesce(h.chunk_id, -1) AS chunk_id FROM _grid g LEFT JOIN hits h ON g.item_id = h.item_id AND g.rank = h.rank)
SELECT item_id, rank, chunk_id FROM _pad WHERE chunk_id <> -1""")
def q_drop_missing_hits(spark, sf):
    # Fixed-width result grid as a flat index returns it: absent neighbours are -1.
    nations = table(spark, sf, "nation").select((F.col("n_nationkey").cast("long") + 1_000_000).alias("item_id"), F.col("n_name").alias("text"))
    asked = table(spark, sf, "benchmark").select("item_id", "text").unionByName(nations)
    grid = asked.select("item_id", F.explode(F.sequence(F.lit(1), F.lit(R.DEFAULT_TOP_K))).alias("rank"))
    hits = R.knn_sparse(asked, _chunks(spark, sf), k=R.DEFAULT_TOP_K)
    padded = grid.join(hits.select("item_id", "rank", "chunk_id"), ["item_id", "rank"], "left") \
                 .withColumn("chunk_id", F.coalesce("chunk_id", F.lit(-1).cast("long")))
    return padded.filter(F.col("chunk_id") != -1).select("item_id", "rank", "chunk_id")


@register("rag_context", f"WITH {RAG_CONTEXT} SELECT item_id, context FROM ctx")
def q_rag_context(spark, sf):
    return retrieve_with_context(spark, sf)


@register("compose_title", """
SELECT doc_id, 'Title: ' || source || chr(10) || text AS doc_text FROM documents""")
def q_compose_title(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.compose_title("source", "text").alias("doc_text"))


@register("scan_index_corpus", "SELECT doc_id, source AS title, text FROM documents")
def q_scan_index_corpus(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")


# ------------------------------------------------------------------ dense kNN

_CENTROIDS = """
_e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
_x AS (SELECT label, i, round(avg(e[i]), 6) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM _e) GROUP BY label, i),
cent AS (SELECT label, list(x ORDER BY i) AS q FROM _x GROUP BY label)"""


def _centroids(spark, sf):
    return R.mean_pool(table(spark, sf, "embeddings"), "label", "embedding", decimals=6)


@register("mean_pool", f"WITH {_CENTROIDS} SELECT label, q AS embedding FROM cent")
def q_mean_pool(spark, sf):
    return _centroids(spark, sf)


@register("l2_normalize", """
WITH _e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
_n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM _e)
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS norm_sq, list_transform(u, lambda x: round(x, 9)) AS u FROM _n""")
def q_l2_normalize(spark, sf):
    u = R.l2_normalize(F.col("embedding").cast("array<double>"))
    e = table(spark, sf, "embeddings").select("vec_id", u.alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm_sq"),
                    F.transform("u", lambda x: F.round(x, 9)).alias("u"))


def _knn_sql(score: str, order: str) -> str:
    return f"""WITH {_CENTROIDS},
_s AS (SELECT c.label, e.vec_id, round({score}, 6) AS score FROM cent c, _e e),
_r AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY score {order}, vec_id) AS INTEGER) AS rank, vec_id, score FROM _s)
SELECT label, rank, vec_id, score FROM _r WHERE rank <= 5"""


@register("knn_ip", _knn_sql("list_inner_product(e.e, c.q)", "DESC"))
def q_knn_ip(spark, sf):
    return R.knn_dense(_centroids(spark, sf), table(spark, sf, "embeddings"), k=5, metric="ip",
                       query_id="label").select(F.col("label").cast("int"), "rank", "vec_id", "score")


@register("knn_l2", _knn_sql("list_sum(list_transform(range(1, len(e.e) + 1), lambda i: (e.e[i] - c.q[i]) * (e.e[i] - c.q[i])))", "ASC"))
def q_knn_l2(spark, sf):
    return R.knn_dense(_centroids(spark, sf), table(spark, sf, "embeddings"), k=5, metric="l2",
                       query_id="label").select(F.col("label").cast("int"), "rank", "vec_id", "score")


# ------------------------------------------------------------------ embedding hook

_EMBED_SQL = f"""{CHUNKS},
_tok AS (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(chunk_text), '\\s+'), lambda x: x <> '')) AS token FROM chunks),
_bk AS (SELECT chunk_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM _tok GROUP BY ALL),
_w AS (SELECT chunk_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM _bk)
SELECT chunk_id, count(*) AS n_nonzero, round(max(w), 6) AS max_weight, CAST(arg_min(bucket, (-round(w, 9), bucket)) AS INTEGER) AS top_bucket
FROM _w GROUP BY chunk_id"""


@register("embed_udf", "WITH " + _EMBED_SQL)
def q_embed_udf(spark, sf):
    from tessera.functions.hooks import embed_udf
    c = _chunks(spark, sf).select("chunk_id", embed_udf()("chunk_text").alias("v"))
    nz = F.filter(F.col("v"), lambda x: x > 0)
    top = F.array_max(F.col("v"))
    r = c.select("chunk_id", F.size(nz).cast("long").alias("n_nonzero"), F.round(top, 6).alias("max_weight"),
                 F.transform("v", lambda x: F.round(x, 9)).alias("r"))
    return r.select("chunk_id", "n_nonzero", "max_weight", (F.array_position("r", F.array_max("r")) - 1).cast("int").alias("top_bucket"))


def _embedded_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""
{name}_t AS (SELECT {id_col} AS id, unnest(list_filter(string_split_regex(lower({text_col}), '\\s+'), lambda x: x <> '')) AS token FROM {src}),
{name}_b AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_b)"""


@register("dense_retrieval", f"""WITH {CHUNKS},
{_embedded_sql("_q", "benchmark", "item_id", "text")}, {_embedded_sql("_c", "chunks", "chunk_id", "chunk_text")},
_s AS (SELECT i.item_id, c.chunk_id, round(coalesce(s.score, 0.0), 6) AS score FROM benchmark i CROSS JOIN chunks c
       LEFT JOIN (SELECT _q.id AS item_id, _c.id AS chunk_id, sum(_q.w * _c.w) AS score FROM _q JOIN _c USING (bucket) GROUP BY ALL) s
       ON s.item_id = i.item_id AND s.chunk_id = c.chunk_id),
_r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM _s)
SELECT r.item_id, r.rank, r.chunk_id, r.score, c.chunk_text FROM _r r JOIN chunks c ON r.chunk_id = c.chunk_id WHERE r.rank <= {R.RAG_TOP_K}""")
def q_dense_retrieval(spark, sf):
    """Documents -> chunks -> vectors, stored as the index with its vectors; questions -> vectors -> top-k -> text."""
    from tessera.functions.hooks import embed_udf
    from tessera.session import stored
    embed = embed_udf()
    index = stored(_chunks(spark, sf).withColumn("embedding", embed("chunk_text")), "vector-index")
    asked = table(spark, sf, "benchmark").select("item_id", embed("text").alias("embedding"))
    hits = R.knn_dense(asked, index, k=R.RAG_TOP_K, query_id="item_id", corpus_id="chunk_id")
    return R.lookup_text(hits, index).select("item_id", "rank", "chunk_id", "score", "chunk_text")
