"""Streaming jobs built on ``readStream`` / ``writeStream``.

Sinks are tables in the shared checkpoint folder written from ``foreachBatch``.
Each micro-batch overwrites its own ``batch_id=`` partition, so a batch that is
replayed after a failure replaces its earlier output instead of duplicating it;
the stream checkpoint records which batches are done.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.session import checkpoint_dir


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    root = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    return os.path.join(root, "table"), os.path.join(root, "_checkpoint")


def _idempotent_writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out))
    return write


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder; a single file path streams that file
    (its folder is read with a glob filter, as a file source needs a folder).

    ``max_files`` files make one micro-batch; by default a trigger takes all files that
    have arrived, so a backlog is one batch and its event times need no file order.
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():
        folder, name = os.path.split(path)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def stream_append_index(spark: SparkSession, docs_path: str, out: str | None = None,
                        checkpoint: str | None = None, max_files: int | None = None) -> str:
    """Chunk arriving documents into the index table. Ids are content-addressed,
    xxhash64(doc_id, chunk_no), so a replayed batch produces the same ids."""
    out_, ck_ = _paths(spark, "append_index")
    out, checkpoint = out or out_, checkpoint or ck_
    docs = file_stream(spark, docs_path, max_files)
    chunks = R.chunk_documents(docs).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_no"))
    q = (chunks.writeStream.foreachBatch(_idempotent_writer(out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_running_metrics(spark: SparkSession, events_path: str, window: str = "10 minutes",
                           watermark: str = "30 minutes", out: str | None = None,
                           checkpoint: str | None = None, max_files: int | None = None) -> str:
    """Event-time windowed counts and sums per event type, with a watermark for late rows.

    Update mode keeps only changed windows per micro-batch; the sink upserts by
    overwriting the batch partition, and readers take the latest batch per window. Rows
    later than ``watermark`` behind the batches before are dropped, as Structured Streaming
    defines; with files in no time order over several batches, choose a watermark as long
    as their disorder. ``dropped_late_rows`` tells how many there were, as Spark counts them:
    after rows of one window in one task are combined.
    """
    out_, ck_ = _paths(spark, "running_metrics")
    out, checkpoint = out or out_, checkpoint or ck_
    ev = file_stream(spark, events_path, max_files).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    agg = ev.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"))
    flat = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "event_type", "n_events", "total_value")
    q = (flat.writeStream.outputMode("update").foreachBatch(_idempotent_writer(out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    spark.createDataFrame([(late,)], "dropped_late_rows long").write.mode("overwrite").parquet(f"{out}-late")
    return out


def dropped_late_rows(spark: SparkSession, out: str) -> int:
    """Rows (combined per window and task) the watermark dropped in the last run of ``out``."""
    return spark.read.parquet(f"{out}-late").first()[0]


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Final state of an update-mode sink: the row of the latest batch per key."""
    t = spark.read.parquet(out)
    return t.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in t.columns if c not in keys]), "batch_id").alias("s")) \
            .select(*keys, "s.*").drop("batch_id")


def stream_score(spark: SparkSession, docs_path: str, model: DataFrame, out: str | None = None,
                 checkpoint: str | None = None, max_files: int | None = None) -> str:
    """Bits of each arriving document under a static bigram model.

    A document is scored whole in its micro-batch, so no streaming state is kept.
    """
    from tessera.operators import lm

    out_, ck_ = _paths(spark, "score")
    out, checkpoint = out or out_, checkpoint or ck_
    write = _idempotent_writer(out)
    docs = file_stream(spark, docs_path, max_files)
    q = (docs.writeStream.foreachBatch(lambda batch, i: write(lm.document_bits(batch, model), i))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out
