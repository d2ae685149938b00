"""Streaming results equal the batch results; replays do not duplicate."""

from pyspark.sql import functions as F

from tessera.operators import lm, retrieval as R
from tessera.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_stream_index_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(src)          # three files: three micro-batches
    out = S.stream_append_index(spark, src, max_files=1)
    streamed = spark.read.parquet(out).select("doc_id", "chunk_no", "chunk_text")
    batch = R.chunk_documents(docs)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3


def test_stream_replay_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.stream_append_index(spark, src, out=out, checkpoint=ck)
    n = spark.read.parquet(out).count()
    S.stream_append_index(spark, src, out=out, checkpoint=ck)      # restart: nothing new
    assert spark.read.parquet(out).count() == n


def test_stream_score_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train_bigram(docs)
    src = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(src)
    out = S.stream_score(spark, src, model, max_files=1)
    s = spark.read.parquet(out).select("doc_id", F.round("bits", 6).alias("bits"))
    b = lm.document_bits(docs, model).select("doc_id", F.round("bits", 6).alias("bits"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_metrics_over_unsorted_files_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "events")
    events.repartition(4).write.parquet(src)           # four files, each over the whole time
    keys = ["window_start", "window_end", "event_type"]
    want = sorted((r.event_type, r.w.start, r.n) for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(
        F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).collect())
    for kw in ({}, {"max_files": 1, "watermark": "400 days"}):
        out = S.stream_running_metrics(spark, src, **kw)
        got = S.latest_per_key(spark, out, keys)
        assert sorted((r.event_type, r.window_start, r.n_events) for r in got.collect()) == [(e, s.replace(tzinfo=None), n) for e, s, n in want]
        assert S.dropped_late_rows(spark, out) == 0
    out = S.stream_running_metrics(spark, src, max_files=1)
    kept = S.latest_per_key(spark, out, keys).agg(F.sum("n_events")).first()[0]
    assert kept < events.count() and S.dropped_late_rows(spark, out) > 0
