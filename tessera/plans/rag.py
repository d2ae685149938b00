"""Retrieval jobs: build the chunk index and answer a query table with context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import retrieval as R
from tessera.session import table


def retrieve_with_context(spark: SparkSession, sf_dir: str, k: int = R.RAG_TOP_K) -> DataFrame:
    """(item_id, context): top-k chunks of ``documents`` per ``benchmark`` item, in rank order."""
    # the index is built once and stored (as the reference saves its index); scoring
    # and the text lookup both read the stored chunks
    chunks = R.build_chunks(table(spark, sf_dir, "documents"))
    hits = R.knn_sparse(table(spark, sf_dir, "benchmark"), chunks, k=k)
    return R.rag_context(R.lookup_text(hits, chunks))
