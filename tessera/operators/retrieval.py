"""Chunking, chunk ids, sparse and dense exact top-k retrieval, context assembly.

Retrieval is a batch job: queries are a table, the index is a table. The queries
are a stated set, shipped in blocks of bounded size against all index rows; each
task scores its rows in numpy inside Arrow batches and keeps a local top-k per
query before the global top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.bytes import runs
from tessera.operators.ordering import assign_consecutive_ids
from tessera.plans.hints import bounded_broadcast
from tessera.session import stored

# Fixed values that must equal the reference behaviour.
DEFAULT_TOP_K = 5      # retriever default
RAG_TOP_K = 3          # retrieval-conditioned compression default
SCORE_DECIMALS = 6     # scores are rounded before ranking so ties are engine-independent


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    title_col: str | None = "source", size: int = T.CHUNK_SIZE,
                    overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: (doc_id, chunk_no, chunk_text). Narrow: no shuffle."""
    body = T.compose_title(title_col, text_col) if title_col else F.col(text_col)
    w = docs.select(F.col(id_col).alias("doc_id"), T.words(body).alias("_words"))
    return w.select("doc_id", F.posexplode(T.chunk_array("_words", size, overlap)).alias("chunk_no", "chunk_text"))


def build_chunks(docs: DataFrame, start_id: int | F.Column = 0, **kw) -> DataFrame:
    """Chunk table (chunk_id, doc_id, chunk_no, chunk_text) with consecutive ids in
    (doc_id, chunk_no) order: the stored index, so documents are chunked once per job. The chunks
    are stored before they are put in order too: finding the bounds of the order reads them once more."""
    return assign_consecutive_ids(stored(chunk_documents(docs, **kw), "chunks"), ["doc_id", "chunk_no"], start=start_id)


def sparse_weights(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, weight): term frequency of lower-cased words, L2-normalised per id."""
    toks = df.select(F.col(id_col).alias("id"), F.explode(T.lower_words(text_col)).alias("token"))
    tf = toks.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    norm = tf.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norm, "id").select("id", "token", (F.col("tf") / F.col("norm")).alias("weight"))


QUERY_BLOCK_BYTES = 32 << 20      # query weights or vectors shipped to every task at once
MAX_SCORE_CELLS = 1 << 24         # corpus rows x queries scored at once in one task (128 MB of doubles)
SLICE_CELLS = 1 << 18             # of them, scored in one slice by the sparse scan: 2 MB stay in a core's cache
COMMON_TERMS = 256                # query terms of most queries, scored as a matrix product
DENSE_ROWS = 2048                 # corpus rows of one such product
LIST_ENTRIES = 1 << 20            # (row, query) contributions of the other terms added at once


class _TopK:
    """Running top-k per query over corpus rows scored in slices: higher score first, then smaller id."""

    def __init__(self, n_queries: int, k: int):
        import numpy as np
        self.np, self.k, self.cols = np, k, np.arange(n_queries)[None, :]
        self.key = self.ids = None

    def add(self, key, ids) -> None:
        """``key`` (rows, queries), smaller is better, rows in id order; inf marks no match."""
        np, k = self.np, self.k
        if len(key) > 4 * k:                   # keep rows that can be among the k best, ties included
            bound = np.partition(key, k - 1, axis=0)[k - 1]
            rows = np.flatnonzero((key <= bound).any(axis=1))
            key, ids = key[rows], ids[rows]
        order = np.argsort(key, axis=0, kind="stable")[:k]
        key_k, ids_k = key[order, self.cols], ids[order]
        if self.key is not None:
            key_k, ids_k = np.vstack([self.key, key_k]), np.vstack([self.ids, ids_k])
            best = np.lexsort((ids_k, key_k), axis=0)[:k]
            key_k, ids_k = key_k[best, self.cols], ids_k[best, self.cols]
        self.key, self.ids = key_k, ids_k

    def rows(self):
        """(query number, corpus id, key) of what was found."""
        np = self.np
        if self.key is None:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        found = np.isfinite(self.key)
        q = np.broadcast_to(self.cols, self.key.shape)
        return q[found], self.ids[found], self.key[found]


def _blocks(df: DataFrame, key: str, size: F.Column, block_bytes: int) -> list[DataFrame]:
    """``df`` cut by a hash of ``key`` into parts of about ``block_bytes`` (sum of ``size``)."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def knn_sparse(queries: DataFrame, corpus: DataFrame, k: int = RAG_TOP_K,
               query_id: str = "item_id", query_text: str = "text",
               corpus_id: str = "chunk_id", corpus_text: str = "chunk_text",
               block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Exact top-k by cosine of term-frequency vectors: (query_id, rank, corpus_id, score).

    The queries are the stated set, shipped in blocks of bounded size. A corpus row's words
    are counted and normalised where the row is read, so no token row is shuffled and no
    (query, row) pair is written: each task scores its rows against the query terms in
    bounded matrix products, keeps k rows per query, and only those cross the shuffle.
    Rows that share no word with a query are never its hits.
    """
    spark = corpus.sparkSession
    weights = sparse_weights(queries, query_id, query_text)
    c = corpus.select(F.col(corpus_id).cast("long").alias("cid"), F.lower(corpus_text).alias("text"))
    cand = None
    for block in _blocks(weights, "id", F.octet_length("token") + 24, block_bytes):
        rows = block.collect()
        if not rows:
            continue
        bc = spark.sparkContext.broadcast(_query_terms([(r.id, r.token, r.weight) for r in rows]))

        def score(batches, bc=bc):
            yield from _sparse_scores(split_words(batches), *bc.value, k)

        part = c.mapInArrow(score, "qid long, cid long, score double")
        cand = part if cand is None else cand.unionByName(part)
    if cand is None:
        cand = spark.createDataFrame([], "qid long, cid long, score double")
    return top_k(cand, "qid", "score", "cid", k, descending=True).select(
        F.col("qid").alias(query_id), "rank", F.col("cid").alias(corpus_id), "score")


def _query_terms(rows):
    """(ids, term -> column, sparse weights as (term, query, weight) arrays) of one query block."""
    import numpy as np

    ids = sorted({r[0] for r in rows})
    place = {q: i for i, q in enumerate(ids)}
    terms: dict[str, int] = {}
    t = np.array([terms.setdefault(r[1], len(terms)) for r in rows])
    q = np.array([place[r[0]] for r in rows])
    w = np.array([r[2] for r in rows])
    order = np.argsort(t, kind="stable")
    first = np.searchsorted(t[order], np.arange(len(terms) + 1))
    return np.array(ids, np.int64), terms, q[order], w[order], first


def split_words(batches):
    """(cid, text) batches as (cid, words): the words of ``T.words``, split a batch at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        text = pc.utf8_trim_whitespace(b.column("text"))
        words = pc.utf8_split_whitespace(pc.if_else(pc.equal(text, ""), pa.scalar(None, text.type), text))
        yield pa.RecordBatch.from_arrays([b.column("cid"), words], names=["cid", "words"])


def _sparse_scores(batches, ids, terms, q, w, first, k):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    best = _TopK(len(ids), k)
    step = max(1, min(MAX_SCORE_CELLS, SLICE_CELLS) // len(ids))
    held = np.diff(first)                                # queries that hold each term
    common = np.argsort(-held, kind="stable")[:COMMON_TERMS]
    place = np.full(len(terms), -1)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(common), len(ids)))            # their weights as a matrix, the other terms' as lists
    for i, t in enumerate(common.tolist()):
        dense[i, q[first[t]:first[t + 1]]] = w[first[t]:first[t + 1]]
    for b in batches:
        cids = b.column("cid").to_numpy()
        order = np.argsort(cids, kind="stable")
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        # words as numbers of the batch's distinct words: only those become Python strings
        words = b.column("words")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(place_of, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        pair, tf = np.unique(row * max(len(distinct), 1) + code, return_counts=True)
        all_row, code = np.divmod(pair, max(len(distinct), 1))
        norm = np.sqrt(np.bincount(all_row, tf * tf, len(order)))
        term = np.fromiter((terms.get(x, -1) for x in distinct), np.int64, len(distinct))[code]
        on = term >= 0
        all_row, term, tf = all_row[on], term[on], tf[on]
        for at in range(0, len(order), step):
            part = order[at:at + step]
            here = slice(*np.searchsorted(all_row, (at, at + len(part))))
            row, t = all_row[here] - at, term[here]
            weight = tf[here] / norm[at + row]
            score = np.empty((len(part), len(ids)))
            many = place[t] >= 0
            cut = np.searchsorted(row[many], np.arange(0, len(part) + DENSE_ROWS, DENSE_ROWS))
            for r, lo, hi in zip(range(0, len(part), DENSE_ROWS), cut, cut[1:]):
                x = np.zeros((min(DENSE_ROWS, len(part) - r), len(common)))
                x[row[many][lo:hi] - r, place[t[many][lo:hi]]] = weight[many][lo:hi]
                score[r:r + len(x)] = x @ dense
            row, t, weight = row[~many], t[~many], weight[~many]
            size = held[t]
            ends = np.cumsum(size)
            for lo, hi in runs(ends, LIST_ENTRIES):
                n = size[lo:hi]
                entry = np.repeat(first[t[lo:hi]] - (ends[lo:hi] - n), n) + np.arange(ends[lo] - size[lo], ends[hi - 1])
                np.add.at(score, (np.repeat(row[lo:hi], n), q[entry]), w[entry] * np.repeat(weight[lo:hi], n))
            if best.key is not None and len(best.key) == k:          # rows that cannot be among the k best of any query
                on = np.flatnonzero((score >= -best.key[-1] - 10.0 ** -SCORE_DECIMALS).any(axis=1))
                score, part = score[on], part[on]
            key = np.where(score > 0, -np.round(score, SCORE_DECIMALS), np.inf)
            best.add(key, cids[part])
    n, cid, key = best.rows()
    yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(cid.astype(np.int64)), pa.array(-key + 0.0)], names=["qid", "cid", "score"])


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    """Rows ranked 1..k per group; ties broken by the smaller ``tie`` id.

    Spark plans the filtered row_number as a WindowGroupLimit, which also runs
    before the shuffle, so each partition sends at most k rows per group.
    """
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(group).orderBy(order, F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lookup_text(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id",
                text_col: str = "chunk_text") -> DataFrame:
    """Attach chunk text to hits; unknown ids keep a NULL text (left join).

    Hits are few (k per query) and the chunk table is the whole index, so the hits are
    stored once and the chunks cut down by a semi-join against their ids (broadcast if
    their stored size is within bound) before the left join pairs two small sides.
    """
    hits = stored(hits, "hits")
    ids = bounded_broadcast(hits.select(id_col).distinct())
    needed = chunks.select(id_col, text_col).join(ids, id_col, "left_semi")
    return hits.join(needed, id_col, "left")


def rag_context(hits_with_text: DataFrame, query_id: str = "item_id", text_col: str = "chunk_text",
                out: str = "context") -> DataFrame:
    """Per query, hit texts joined by one space in rank order (k rows per query: bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", text_col)))
    return hits_with_text.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda s: s[text_col]), " ").alias(out))


# ---------------------------------------------------------------- dense vectors

def l2_normalize(v) -> F.Column:
    length = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return T.bound(T.col_(v), lambda a: T.bound(length(a), lambda n: F.transform(a, lambda x: x / n)))


def mean_pool(df: DataFrame, group: str, vec: str, decimals: int | None = None) -> DataFrame:
    """Element-wise mean of the vectors of each group, as (group, pooled array).

    Elements are averaged by (group, position) with partial aggregation, so a
    hot group is combined map-side; only one value per position is gathered.
    """
    e = df.select(group, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    avg = e.groupBy(group, "i").agg(F.avg("x").alias("x"))
    if decimals is not None:
        avg = avg.withColumn("x", F.round("x", decimals))
    pooled = F.array_sort(F.collect_list(F.struct("i", "x")))
    return avg.groupBy(group).agg(F.transform(pooled, lambda s: s["x"]).alias(vec))


def _dense_scores(batches, ids, qmat, k, metric, cid, cvec, qid_name, max_cells):
    """Exact top-k per query over all corpus rows of one task, scored in slices of at most
    ``max_cells``; the task emits k rows per query once, however many rows it scanned."""
    import numpy as np
    import pandas as pd

    qn = (qmat * qmat).sum(axis=1)
    step = max(1, max_cells // len(ids))
    best = _TopK(len(ids), k)
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(cid, kind="stable")
        c_all = np.stack(pdf[cvec].to_numpy()).astype(np.float64)
        cids = pdf[cid].to_numpy().astype(np.int64)
        for lo in range(0, len(c_all), step):
            c = c_all[lo:lo + step]
            dots = c @ qmat.T
            if metric == "ip":
                key = -np.round(dots, SCORE_DECIMALS)
            else:
                key = np.round(np.maximum((c * c).sum(axis=1)[:, None] + qn[None, :] - 2 * dots, 0.0), SCORE_DECIMALS)
            best.add(key, cids[lo:lo + step])
    n, found, key = best.rows()
    yield pd.DataFrame({qid_name: ids[n], cid: found, "score": key * (-1.0 if metric == "ip" else 1.0) + 0.0})


def knn_dense(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_TOP_K, metric: str = "ip",
              query_id: str = "qid", query_vec: str = "embedding", corpus_id: str = "vec_id",
              corpus_vec: str = "embedding", block_bytes: int = QUERY_BLOCK_BYTES,
              score_cells: int = MAX_SCORE_CELLS) -> DataFrame:
    """Exact top-k by inner product (higher first) or squared L2 (lower first).

    The queries are the stated set, shipped in blocks of bounded bytes whatever the vector
    width; each task scores its corpus rows with bounded matrix products and keeps one
    running top-k per query, so k rows per query and task cross the shuffle; a
    WindowGroupLimit-planned ranking keeps the global top-k. Ties go to the smaller corpus
    id. Scores are rounded to 6 places. No queries give no rows.
    """
    import numpy as np

    if metric not in ("ip", "l2"):
        raise ValueError("metric must be 'ip' or 'l2'")
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv"))
    schema = f"{query_id} long, {corpus_id} long, score double"
    c = corpus.select(F.col(corpus_id).cast("long").alias(corpus_id),
                      F.col(corpus_vec).cast("array<double>").alias(corpus_vec))
    cand = None
    for block in _blocks(q, "_qid", F.size("_qv") * 8 + 8, block_bytes):
        rows = block.collect()
        if not rows:
            continue
        bc = spark.sparkContext.broadcast((np.array([r._qid for r in rows], np.int64), np.array([r._qv for r in rows], np.float64)))

        def fn(batches, bc=bc):
            i, m = bc.value
            yield from _dense_scores(batches, i, m, k, metric, corpus_id, corpus_vec, query_id, score_cells)

        part = c.mapInPandas(fn, schema)
        cand = part if cand is None else cand.unionByName(part)
    if cand is None:
        cand = spark.createDataFrame([], schema)
    return top_k(cand, query_id, "score", corpus_id, k, descending=(metric == "ip")).select(
        query_id, "rank", corpus_id, "score")
