"""Compression jobs over tables: train the byte model, code blocks, decode, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import codec as C
from tessera.session import table


def corpus_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


def fit_model(data: DataFrame) -> C.ByteModel:
    return C.ByteModel.from_table(C.train_byte_model(data))


def compress_corpus(data: DataFrame, id_col: str = "doc_id", model: C.ByteModel | None = None):
    """(blocks, model): one row per (id, block_no) with the coded payload."""
    model = model or fit_model(data)
    return C.compress_blocks(C.to_blocks(data, id_col, "data"), model, id_col), model


def decompress_corpus(blocks: DataFrame, model: C.ByteModel, id_col: str = "doc_id") -> DataFrame:
    """(id, data): decoded blocks merged in block order."""
    return C.merge_blocks(C.decompress_blocks(blocks, model, id_col), id_col)


def codec_stats(blocks: DataFrame, data: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: original bytes, coded bytes including the 3-byte block headers."""
    per_doc = blocks.groupBy(id_col).agg(
        F.sum(F.col("n_bytes") + 3).cast("long").alias("compressed_bytes"), F.count(F.lit(1)).alias("n_blocks"))
    return data.select(id_col, F.octet_length("data").cast("long").alias("original_bytes")).join(per_doc, id_col, "left")


def with_context(rows: DataFrame, hits: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with the ids of their retrieved chunks in rank order and the chunk texts joined by a blank
    (empty for rows without hits)."""
    from tessera.operators import retrieval as R
    ids = hits.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("context_ids"))
    context = R.rag_context(R.lookup_text(hits, chunks), id_col)
    return (rows.join(ids, id_col, "left").join(context, id_col, "left")
            .withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<long>")))
            .withColumn("context", F.coalesce("context", F.lit(""))))


def context_of_blocks(blocks: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """Blocks with their context rebuilt from the chunk ids they carry."""
    hits = blocks.select(id_col, F.posexplode("context_ids").alias("rank", "chunk_id"))
    return with_context(blocks.drop("context_ids"), hits, chunks, id_col)
