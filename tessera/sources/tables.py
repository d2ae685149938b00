"""Sinks: the retrieval index, coded blocks, payloads and metric logs as tables.

All writes go to a path the caller names (on a cluster: shared storage, such as
the folder in ``spark.checkpoint.dir``); overwrite writes are whole-table or
per-partition, so a rerun replaces instead of duplicating.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.operators import codec as C
from tessera.operators import retrieval as R


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def save_index(chunks: DataFrame, path: str) -> None:
    """Write the chunk store (chunk_id, doc_id, chunk_no, chunk_text[, vector]). It is written beside an
    older one and takes its place by renaming: a build that fails leaves the older index as it was."""
    spark, mark = chunks.sparkSession, uuid.uuid4().hex[:12]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, here = hadoop(f"{path}.new-{mark}"), hadoop(f"{path}.old-{mark}"), hadoop(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        chunks.write.parquet(new.toString())
        if fs.exists(here):
            fs.rename(here, old)
        elif here.getParent() is not None:
            fs.mkdirs(here.getParent())
        if not fs.rename(new, here):
            raise RuntimeError(f"could not put the new index in place of {path}")
    finally:
        if not fs.exists(here) and fs.exists(old):
            fs.rename(old, here)
        for p in (new, old):
            fs.delete(p, True)


def load_or_build_index(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                        force_reindex: bool = False) -> DataFrame:
    """Reuse a stored, non-empty index; otherwise build it, store it and read it back."""
    if not force_reindex and table_exists(spark, path) and spark.read.parquet(path).limit(1).count() > 0:
        return spark.read.parquet(path)
    save_index(build(), path)
    return spark.read.parquet(path)


def next_chunk_id(index: DataFrame) -> int:
    """max(chunk_id) + 1, or 0 for an empty index (one scalar)."""
    m = index.agg(F.max("chunk_id")).collect()[0][0]
    return 0 if m is None else int(m) + 1


MARK_SECONDS = 24 * 3600      # a writer's mark that old belongs to a driver that died


@contextmanager
def single_writer(spark: SparkSession, path: str, expires_s: float = MARK_SECONDS):
    """Hold the writer's mark of a table: a second writer meanwhile is an error. The mark names its owner; one
    older than ``expires_s`` was left by a driver that died and is taken over."""
    hadoop, owner = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    mark = hadoop(f"{path}/_writing")
    fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(mark) and time.time() - fs.getFileStatus(mark).getModificationTime() / 1000 > expires_s:
        fs.rename(mark, hadoop(f"{path}/_expired-{owner}"))      # only one of several writers succeeds
        fs.delete(hadoop(f"{path}/_expired-{owner}"), False)
    if not fs.createNewFile(mark):
        raise RuntimeError(f"another writer is appending to {path}")
    try:
        yield
    finally:
        fs.delete(mark, False)


def append_index(spark: SparkSession, path: str, docs: DataFrame, **chunk_kw) -> int:
    """Chunk new documents with ids continuing after the stored ones and append them; returns the
    first new id. Ids are taken and written under the table's single writer's mark."""
    with single_writer(spark, path):
        start = next_chunk_id(spark.read.parquet(path)) if table_exists(spark, path) else 0
        R.build_chunks(docs, start_id=start, **chunk_kw).write.mode("append").parquet(path)
    return start


def write_blocks(blocks: DataFrame, path: str, pad: str = "pad", length: str = "length",
                 payload: str = "payload", strict: bool = True) -> None:
    """Blob form of coded blocks: 1 byte pad bits, 2 bytes big-endian length, payload.

    Rows outside the ranges (pad 0..7, length 0..65535) fail the job when
    ``strict`` (assert_true), or are written with a NULL blob and their status.
    """
    status = B.block_status(pad, length, payload)
    if strict:
        # the assertion is part of the written value, so column pruning cannot skip it
        check = F.assert_true(status == "ok", F.lit("block header out of range"))
        out = blocks.withColumn("blob", F.when(check.isNull(), B.block_blob(pad, length, payload)))
    else:
        out = blocks.withColumn("status", status).withColumn(
            "blob", F.when(F.col("status") == "ok", B.block_blob(pad, length, payload)))
    out.write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str, blob: str = "blob") -> DataFrame:
    """Parse stored blobs back to (pad, length, payload); an empty blob is an error row."""
    t = spark.read.parquet(path)
    return t.withColumn("_r", B.read_block(blob)).select(
        "*", F.col("_r.pad").alias("pad_bits"), F.col("_r.length").alias("n_symbols"),
        F.col("_r.payload").alias("payload_bytes")).drop("_r")


def write_payload(files: DataFrame, path: str, id_col: str = "path", symbols: str = "symbols") -> None:
    """Strip the trailing pad symbol (256) and store the raw bytes keyed by file path."""
    out = files.select(id_col, B.from_ints(B.strip_padding(symbols)).alias("content"))
    out.write.mode("overwrite").parquet(path)


def save_byte_model(spark: SparkSession, model: C.ByteModel, path: str) -> str:
    """Add a byte model to the model store; returns its id. Saving it again replaces equal rows."""
    (spark.createDataFrame(model.to_rows()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model_id").parquet(path))
    return model.model_id


def load_byte_model(spark: SparkSession, path: str, model_id: str) -> C.ByteModel:
    """The stored byte model of an id (as blocks carry it)."""
    rows = spark.read.schema("ctx int, sym int, freq long, cum long, model_id string").parquet(path)
    model = C.ByteModel.from_table(rows.filter(F.col("model_id") == model_id))
    if model.model_id != model_id:
        raise ValueError(f"stored model {model_id} is damaged")
    return model


def save_bigram_model(model: DataFrame, path: str) -> None:
    """The n-gram model table as trained (a, b, n_ab, n_a, vocab, p, bits)."""
    model.write.mode("overwrite").parquet(path)


def append_metrics_log(metrics: DataFrame, path: str) -> None:
    """Append one epoch's metrics rows to the log table."""
    metrics.write.mode("append").parquet(path)
