"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import CHUNKS, DOC_STATS
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.plans.scoring import doc_compression_stats
from tessera.session import table

QUALITY_MIN_RATIO = 2.0   # predicted quality: document compresses at least this well


def _ratio_sql(o, c):
    return f"CASE WHEN {o} <> 0 AND {c} <> 0 THEN {o} / {c} ELSE 0.0 END"


@register("metric_totals", f"""WITH {DOC_STATS}
SELECT count(*) AS n_items, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes,
       CAST(sum(original_bytes) AS BIGINT) AS original_bytes,
       round({_ratio_sql("sum(original_bytes)", "sum(compressed_bytes)")}, 6) AS ratio,
       round({_ratio_sql("sum(compressed_bytes)", "sum(original_bytes)")}, 6) AS rate FROM stats""")
def q_metric_totals(spark, sf):
    t = M.metric_totals(doc_compression_stats(spark, sf))
    return t.select("n_items", "compressed_bytes", "original_bytes",
                    F.round("ratio", 6).alias("ratio"), F.round("rate", 6).alias("rate"))


@register("compression_ratio", f"""WITH {DOC_STATS}
SELECT doc_id,
       round({_ratio_sql("original_bytes", "(compressed_bytes + 3)")}, 6) AS ratio,
       round({_ratio_sql("(compressed_bytes + 3)", "original_bytes")}, 6) AS rate,
       round({_ratio_sql("n_chars", "(compressed_bytes + 3)")}, 6) AS ratio_chars FROM stats""")
def q_compression_ratio(spark, sf):
    s = doc_compression_stats(spark, sf)
    comp = F.col("compressed_bytes") + M.BLOCK_HEADER_BYTES
    return s.select("doc_id", F.round(M.ratio(F.col("original_bytes"), comp), 6).alias("ratio"),
                    F.round(M.rate(F.col("original_bytes"), comp), 6).alias("rate"),
                    F.round(M.ratio(F.col("n_chars"), comp), 6).alias("ratio_chars"))


@register("metric_rollup", f"""WITH {DOC_STATS}
SELECT lang, source, CAST(grouping(lang, source) AS INTEGER) AS level, count(*) AS n_items,
       CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes,
       round({_ratio_sql("sum(original_bytes)", "sum(compressed_bytes)")}, 6) AS ratio
FROM stats GROUP BY ROLLUP (lang, source)""")
def q_metric_rollup(spark, sf):
    r = M.metric_rollup(doc_compression_stats(spark, sf), ["lang", "source"])
    return r.withColumn("level", F.col("level").cast("int")).withColumn("ratio", F.round("ratio", 6))


@register("running_ratio", f"""WITH {DOC_STATS},
_c AS (SELECT doc_id, CAST(sum(original_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_original_bytes,
              CAST(sum(compressed_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_compressed_bytes FROM stats)
SELECT doc_id, cum_original_bytes, cum_compressed_bytes,
       round({_ratio_sql("cum_original_bytes", "cum_compressed_bytes")}, 6) AS running_ratio FROM _c""")
def q_running_ratio(spark, sf):
    s = doc_compression_stats(spark, sf).select("doc_id", "original_bytes", "compressed_bytes")
    r = M.running_sums(s, ["doc_id"], ["original_bytes", "compressed_bytes"])
    return r.select("doc_id", F.col("cum_original_bytes").cast("long"), F.col("cum_compressed_bytes").cast("long"),
                    F.round(M.ratio(F.col("cum_original_bytes"), F.col("cum_compressed_bytes")), 6).alias("running_ratio"))


@register("space_saved", f"""WITH {DOC_STATS}
SELECT doc_id, original_bytes, compressed_bytes,
       round(CASE WHEN original_bytes <> 0 THEN 100 * (1 - compressed_bytes / original_bytes) ELSE 0.0 END, 4) AS space_saved_pct,
       round({_ratio_sql("original_bytes", "compressed_bytes")}, 6) AS ratio FROM stats""")
def q_space_saved(spark, sf):
    s = doc_compression_stats(spark, sf)
    o, c = F.col("original_bytes"), F.col("compressed_bytes")
    return s.select("doc_id", "original_bytes", "compressed_bytes",
                    F.round(M.space_saved(o, c), 4).alias("space_saved_pct"), F.round(M.ratio(o, c), 6).alias("ratio"))


@register("corpus_length", """
SELECT count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS total_chars,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents""")
def q_corpus_length(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).cast("long").alias("total_chars"),
                 F.sum(F.octet_length("text")).cast("long").alias("total_bytes"))


@register("chunk_stats", f"""WITH {CHUNKS}
SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents,
       round(count(*) / count(DISTINCT doc_id), 6) AS avg_chunks_per_document FROM chunks""")
def q_chunk_stats(spark, sf):
    c = R.chunk_documents(table(spark, sf, "documents"))
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents")).withColumn(
        "avg_chunks_per_document", F.round(F.col("n_chunks") / F.col("n_documents"), 6))


@register("accuracy", f"""WITH {DOC_STATS},
_p AS (SELECT s.lang, CAST(original_bytes >= {QUALITY_MIN_RATIO} * compressed_bytes AS INTEGER) AS pred, l.quality
       FROM stats s JOIN labels l ON s.doc_id = l.doc_id)
SELECT lang, count(*) AS n, round(avg(CAST(pred = quality AS INTEGER)), 6) AS accuracy FROM _p GROUP BY ROLLUP (lang)""")
def q_accuracy(spark, sf):
    s = doc_compression_stats(spark, sf)
    p = s.join(table(spark, sf, "labels"), "doc_id").select(
        "lang", "quality",
        (F.col("original_bytes") >= QUALITY_MIN_RATIO * F.col("compressed_bytes")).cast("int").alias("pred"))
    return M.accuracy(p, "pred", "quality", by=["lang"], total=True).withColumn("accuracy", F.round("accuracy", 6))


# Per-epoch metrics: each day of the event log stands in for one epoch.
_EPOCHS_SQL = """
_ep AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS epoch, value FROM events),
epochs AS (SELECT epoch, round(avg(CAST(value > 10 AS INTEGER)), 4) AS acc, round(avg(value), 4) AS loss FROM _ep GROUP BY epoch)"""


def _epochs(spark, sf):
    e = table(spark, sf, "events")
    ep = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("int").alias("epoch")
    return e.groupBy(ep).agg(F.round(F.avg((F.col("value") > 10).cast("int")), 4).alias("acc"),
                             F.round(F.avg("value"), 4).alias("loss"))


@register("best_epoch", f"""WITH {_EPOCHS_SQL}
SELECT (SELECT epoch FROM epochs ORDER BY acc DESC, epoch LIMIT 1) AS best_acc_epoch, (SELECT max(acc) FROM epochs) AS best_acc,
       (SELECT epoch FROM epochs ORDER BY loss, epoch LIMIT 1) AS best_loss_epoch, (SELECT min(loss) FROM epochs) AS best_loss""")
def q_best_epoch(spark, sf):
    ep = _epochs(spark, sf)
    acc = M.best_epoch(ep, "epoch", "acc").select(F.col("best_epoch").alias("best_acc_epoch"), F.col("best_value").alias("best_acc"))
    loss = M.best_epoch(ep, "epoch", "loss", higher_is_better=False).select(
        F.col("best_epoch").alias("best_loss_epoch"), F.col("best_value").alias("best_loss"))
    one = F.lit(1).alias("_k")                       # one row on each side
    return acc.select(one, "*").join(loss.select(one, "*"), "_k").drop("_k")


@register("best_so_far", f"""WITH {_EPOCHS_SQL},
_b AS (SELECT epoch, loss, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM epochs)
SELECT epoch, loss, prev_best, (prev_best IS NULL OR loss < prev_best) AS improved FROM _b""")
def q_best_so_far(spark, sf):
    return M.best_so_far(_epochs(spark, sf).select("epoch", "loss"), "epoch", "loss", higher_is_better=False)
