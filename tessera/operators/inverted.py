"""Exact sparse kNN over a stored inverted index, pruned by upper bounds.

The index is three tables. *Vectors* hold each corpus row's terms with their weights (term frequency over
the row's norm, so a row has length one). *Postings* hold, for each term, its rows in blocks of falling
weight, each with its largest weight; lists are cut by ranges of the row id, so no list is gathered whole.
*Terms* hold the list lengths and largest weights.

A search is joins from start to end. Some rows found through each query's rarest terms are scored; the k-th
best is a score that every hit must reach. Then, with q and d the weights of query and row,

* common terms that cannot reach it together (their norm in q is below it, as d has length one) are not
  looked up: a hit holds at least one of the other, essential terms;
* a block whose largest weight m cannot reach it is not read: a row with weight w <= m in that term scores
  at most q w + sqrt(|q|^2 - q^2) sqrt(1 - w^2);
* a row found with essential sum S and squared weights W is scored only if S + |q_rest| sqrt(1 - W) reaches it.

What is left is scored whole, from the vectors. Bounds only ever drop rows that cannot be hits, so the
result is that of a full scan. Rows that share no term with a query are never its hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.retrieval import RAG_TOP_K, SCORE_DECIMALS, sparse_weights, split_words, top_k
from tessera.plans.hints import bounded_broadcast
from tessera.session import scratch_path, stored

BLOCK_POSTINGS = 128
LIST_IDS = 1 << 16        # row ids that one posting list spans: the most entries it can have
SEED_TERMS = 8            # rarest terms of a query that find its first rows
SEED_ROWS = 4             # first rows scored, as a multiple of k
TASK_PAIRS = 1 << 21      # (row, query) sums of one task
SLACK = 10.0 ** -SCORE_DECIMALS


@dataclass
class SparseIndex:
    vectors: DataFrame    # cid, terms array<struct<token, weight>>
    postings: DataFrame   # token, part, block, most, entries array<struct<weight, cid>>
    terms: DataFrame      # token, df, most


def _vectors(batches):
    """(cid, terms) of the rows that hold words, counted and weighed where they are read."""
    kind = pa.struct([("token", pa.string()), ("weight", pa.float64())])
    for b in split_words(batches):
        words = b.column("words")
        coded = words.flatten().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        pair, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        row, word = np.divmod(pair, size)
        weight = n / np.sqrt(np.bincount(row, n * n, len(b)))[row]
        ids, first = np.unique(row, return_index=True)
        terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(weight)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), terms)
        yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(ids)), lists], names=["cid", "terms"])


def build(corpus: DataFrame, path: str | None = None, id_col: str = "chunk_id", text_col: str = "chunk_text") -> SparseIndex:
    """Index the rows of ``corpus`` (unique long ids) and store it under ``path``."""
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "sparse-index")
    rows = corpus.select(F.col(id_col).cast("long").alias("cid"), F.lower(text_col).alias("text"))
    rows.mapInArrow(_vectors, "cid long, terms array<struct<token: string, weight: double>>").write.parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    flat = vectors.select("cid", F.explode("terms").alias("t")).select("cid", "t.token", "t.weight")
    part = F.floor(F.col("cid") / LIST_IDS).cast("long")
    lists = flat.groupBy("token", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "cid"))).alias("p"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / BLOCK_POSTINGS).cast("int")),
                         lambda i: F.slice("p", i * BLOCK_POSTINGS + 1, BLOCK_POSTINGS))
    cut = lists.select("token", "part", F.posexplode(blocks).alias("block", "p"))
    cut.select("token", "part", "block", (-F.col("p")[0]["less"]).alias("most"),
               F.transform("p", lambda x: F.struct((-x.less).alias("weight"), x.cid.alias("cid"))).alias("entries")).write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("token").agg(F.sum(F.size("entries")).cast("long").alias("df"), F.max("most").alias("most")).write.parquet(f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> SparseIndex:
    return SparseIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "postings", "terms")))


def query_terms(queries: DataFrame, index: SparseIndex, id_col: str, text_col: str) -> DataFrame:
    """(qid, token, q, df, most): the queries' normalised terms that the index holds."""
    q = stored(sparse_weights(queries.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col), "query-terms")
    return stored(index.terms.join(bounded_broadcast(q.withColumnRenamed("id", "qid").withColumnRenamed("weight", "q")), "token")
                  .select("qid", "token", "q", "df", "most"), "query-terms")


def exact_scores(pairs: DataFrame, terms: DataFrame, index: SparseIndex) -> DataFrame:
    """(qid, cid, score) of the given (qid, cid): whole products, from the stored vectors."""
    few = bounded_broadcast(pairs.select("cid").distinct())
    rows = index.vectors.join(few, "cid", "left_semi").select("cid", F.explode("terms").alias("t")).select("cid", "t.token", "t.weight")
    q = bounded_broadcast(terms.select("qid", "token", "q"))
    return (pairs.join(rows, "cid").join(q, ["qid", "token"]).groupBy("qid", "cid")
            .agg(F.round(F.sum(F.col("q") * F.col("weight")), SCORE_DECIMALS).alias("score")))


def first_bounds(terms: DataFrame, index: SparseIndex, k: int) -> DataFrame:
    """(qid, bound): a score that the k-th hit reaches at least; no row where fewer than k rows were found."""
    rare = Window.partitionBy("qid").orderBy("df", "token")
    seeds = terms.withColumn("r", F.row_number().over(rare)).where(F.col("r") <= SEED_TERMS)
    near = (F.col("block") == 0) & ((F.col("df") <= LIST_IDS) | (F.col("part") == 0))
    tops = index.postings.where("block = 0").join(bounded_broadcast(seeds.select("qid", "token", "q", "df")), "token").where(near)
    found = tops.select("qid", "q", F.explode("entries").alias("e")).groupBy("qid", F.col("e.cid").alias("cid")).agg(F.sum(F.col("q") * F.col("e.weight")).alias("s"))
    some = stored(top_k(found, "qid", "s", "cid", SEED_ROWS * k).select("qid", "cid"), "seed-rows")
    best = top_k(exact_scores(some, terms, index), "qid", "score", "cid", k)
    return stored(best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") == k).select("qid", "bound"), "first-bounds")


def candidates(terms: DataFrame, index: SparseIndex, k: int) -> DataFrame:
    """(qid, cid): all rows whose upper bound reaches the first bound of their query."""
    bound = first_bounds(terms, index, k)
    t = terms.join(bounded_broadcast(bound), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK)
    common = Window.partitionBy("qid").orderBy(F.col("df").desc(), "token").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("norm", F.sum(F.col("q") * F.col("q")).over(common)).withColumn(
        "reach", F.least(F.sqrt("norm"), F.sum(F.col("q") * F.col("most")).over(common)))
    whole = Window.partitionBy("qid")
    idle = F.col("reach") < F.col("bound")                  # with all more common terms, still below the bound
    t = t.withColumn("rest", F.coalesce(F.max(F.when(idle, F.col("norm"))).over(whole), F.lit(0.0))).withColumn(
        "all", F.sum(F.col("q") * F.col("q")).over(whole))
    t = stored(t.where(~idle).select("qid", "token", "q", "bound", "rest", "all"), "essential-terms")
    w = F.least(F.col("most"), F.col("q") / F.sqrt("all"))  # the bound grows with w up to here
    alive = F.col("q") * w + F.sqrt(F.greatest(F.col("all") - F.col("q") * F.col("q"), F.lit(0.0)) * (1 - w * w)) >= F.col("bound")
    # Blocks that some query reads; their entries meet by row, before they are spread over the queries: a posting crosses the
    # shuffle once, and a task's sums are at most TASK_PAIRS on average.
    met = index.postings.withColumnRenamed("token", "_token")
    read = met.join(bounded_broadcast(t), (F.col("_token") == F.col("token")) & alive, "left_semi").select(F.col("_token").alias("token"), "most", F.explode("entries").alias("e"))
    n = -(-index.vectors.count() * max(t.select("qid").distinct().count(), 1) // TASK_PAIRS)
    read = read.select("token", "most", "e.cid", "e.weight").repartition(max(n, t.sparkSession.sparkContext.defaultParallelism), "cid")
    sums = read.join(bounded_broadcast(t), "token").where(alive).groupBy("cid", "qid").agg(
        F.sum(F.col("q") * F.col("weight")).alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("w"))
    sums = sums.join(bounded_broadcast(t.select("qid", "bound", "rest").distinct()), "qid")
    upper = F.col("s") + F.sqrt(F.col("rest") * F.greatest(1 - F.col("w"), F.lit(0.0)))
    return sums.where(upper >= F.col("bound")).select("qid", "cid")


def knn(queries: DataFrame, index: SparseIndex, k: int = RAG_TOP_K, id_col: str = "item_id", text_col: str = "text",
        corpus_id: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Hits (query id, rank, corpus id, score), the k best rows of each query, ties by the smaller id; and
    the stored (qid, cid) that were scored to find them."""
    terms = query_terms(queries, index, id_col, text_col)
    scored = stored(candidates(terms, index, k), "scored-rows")
    hits = top_k(exact_scores(scored, terms, index), "qid", "score", "cid", k)
    return hits.select(F.col("qid").alias(id_col), "rank", F.col("cid").alias(corpus_id), "score"), scored
