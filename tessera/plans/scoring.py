"""Corpus scoring job: per-document model bits and the compressed size they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lm
from tessera.session import table


def doc_compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, original_bytes, bits, compressed_bytes).

    compressed_bytes = ceil(bits / 8): the size an ideal coder driven by the
    corpus bigram model reaches; the lane coder lands within a small per-block
    overhead of it.
    """
    docs = table(spark, sf_dir, "documents")
    bits = lm.document_bits(docs, lm.train_bigram(docs))
    # lengths are taken before the join: no text crosses a shuffle
    sizes = docs.select("doc_id", "lang", "source", F.length("text").alias("n_chars"),
                        F.octet_length("text").cast("long").alias("original_bytes"))
    return sizes.join(bits, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "original_bytes", F.round("bits", 4).alias("bits"),
        F.ceil(F.round("bits", 4) / 8).cast("long").alias("compressed_bytes"))
