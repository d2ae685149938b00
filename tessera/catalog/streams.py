"""Registered streaming jobs; each runs to completion (availableNow) and returns its sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import CHUNKS, DOC_STATS, MODEL, doc_bits_sql
from tessera.operators import lm
from tessera.plans.scoring import doc_compression_stats
from tessera.session import scratch_path, table
from tessera.streaming import jobs as S
from tessera.streaming import running as RN


@register("stream_append_index", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_text FROM chunks")
def q_stream_append_index(spark, sf):
    out = S.stream_append_index(spark, f"{sf}/documents.parquet")
    return spark.read.parquet(out).select("doc_id", "chunk_no", "chunk_text")


@register("stream_running_metrics", """
SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end,
       event_type, count(*) AS n_events, round(sum(value), 6) AS total_value
FROM events GROUP BY ALL""")
def q_stream_running_metrics(spark, sf):
    out = S.stream_running_metrics(spark, f"{sf}/events.parquet")
    t = S.latest_per_key(spark, out, ["window_start", "window_end", "event_type"])
    return t.select("window_start", "window_end", "event_type", "n_events", F.round("total_value", 6).alias("total_value"))


@register("stream_score", f"""WITH {MODEL},
{doc_bits_sql("_db", "documents", "doc_id", "text")}
SELECT id AS doc_id, n_coded, round(bits, 4) AS bits FROM _db""")
def q_stream_score(spark, sf):
    model = lm.train_bigram(table(spark, sf, "documents"))
    out = S.stream_score(spark, f"{sf}/documents.parquet", model)
    t = S.latest_per_key(spark, out, ["doc_id"])
    return t.select("doc_id", "n_coded", F.round("bits", 4).alias("bits"))


@register("stream_running_ratio", f"""WITH {DOC_STATS}
SELECT source, count(*) AS n_items, CAST(sum(original_bytes) AS BIGINT) AS cum_original_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS cum_compressed_bytes,
       round(CASE WHEN sum(compressed_bytes) <> 0 THEN sum(original_bytes) / sum(compressed_bytes) ELSE 0.0 END, 6) AS running_ratio FROM stats GROUP BY source""")
def q_stream_running_ratio(spark, sf):
    """Sizes of coded documents arrive in several files and batches; each source's running totals are kept as state."""
    arrived = scratch_path(spark, "coded-sizes")
    doc_compression_stats(spark, sf).select("source", "doc_id", "original_bytes", "compressed_bytes").repartition(3, F.xxhash64("doc_id")).write.parquet(arrived)
    out = RN.stream_running_ratio(spark, arrived, (F.col("original_bytes"), F.col("compressed_bytes")), max_files=1)
    return RN.last_totals(spark, out, "source").withColumn("running_ratio", F.round("running_ratio", 6))
