"""Running totals and ratios for each key of a stream, kept as state.

Each arriving row gets its key's totals up to and including itself. State per key is three numbers and
the last arrival; keys that stay silent longer than ``expire_after`` are closed and start anew. A key's rows
come to its task in pieces of bounded size, so a key with a third of all rows is streamed, not
gathered; rows of one piece are taken in the order of their id, pieces and batches as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.jobs import _idempotent_writer, _paths, file_stream

STATE = "n_items long, cum_original_bytes long, cum_compressed_bytes long"


def running_totals(rows: DataFrame, key: str, id_col: str, original: str, compressed: str, expire_after: str = "1 day") -> DataFrame:
    """(key, id, n_items, cum_original_bytes, cum_compressed_bytes, running_ratio) of a streaming DataFrame."""
    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {id_col} long, {STATE}, running_ratio double"
    millis = int(pd.Timedelta(expire_after).total_seconds() * 1000)

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, o, c = state.get if state.exists else (0, 0, 0)
        for pdf in parts:
            pdf = pdf.sort_values(id_col, kind="stable")
            count = n + pd.Series(range(1, len(pdf) + 1), index=pdf.index)
            cum_o, cum_c = o + pdf[original].fillna(0).cumsum().astype("int64"), c + pdf[compressed].fillna(0).cumsum().astype("int64")
            if len(pdf):
                n, o, c = int(count.iloc[-1]), int(cum_o.iloc[-1]), int(cum_c.iloc[-1])
            yield pd.DataFrame({key: name[0], id_col: pdf[id_col], "n_items": count, "cum_original_bytes": cum_o, "cum_compressed_bytes": cum_c,
                                "running_ratio": (cum_o / cum_c.where(cum_c != 0)).fillna(0.0)})
        state.update((n, o, c))
        state.setTimeoutDuration(millis)

    return (rows.select(key, id_col, original, compressed).groupBy(key)
            .applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout))


def stream_running_ratio(spark: SparkSession, docs_path: str, score, key: str = "source", id_col: str = "doc_id", out: str | None = None,
                         checkpoint: str | None = None, max_files: int | None = None, state_partitions: int | None = None) -> str:
    """Running totals per ``key`` of the documents arriving in a folder. ``score`` is the pair of column expressions
    (original bytes, compressed bytes). The state is dealt out over ``state_partitions`` (by default twice the
    cores, at most the session's shuffle partitions), which a checkpoint keeps for good. Returns the sink table."""
    out_, ck_ = _paths(spark, "running_ratio")
    out, checkpoint = out or out_, checkpoint or ck_
    original, compressed = score
    docs = file_stream(spark, docs_path, max_files).select(key, id_col, original.cast("long").alias("original_bytes"), compressed.cast("long").alias("compressed_bytes"))
    # Silent keys are closed when the next rows arrive: with a timeout set, batches without data would follow each
    # other without end under the available-now trigger. A query keeps the settings it was started with.
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {"spark.sql.shuffle.partitions": str(state_partitions or min(wide, 2 * spark.sparkContext.defaultParallelism)),
           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    usual = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        q = (running_totals(docs, key, id_col, "original_bytes", "compressed_bytes").writeStream.outputMode("append").foreachBatch(_idempotent_writer(out))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    q.awaitTermination()
    return out


def last_totals(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The latest totals of each key."""
    t = spark.read.parquet(out)
    cols = ["n_items", "cum_original_bytes", "cum_compressed_bytes", "running_ratio"]
    return t.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("batch_id", "n_items")).alias("s")).select(key, "s.*")
