"""Compression and evaluation metrics as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import running_agg

BLOCK_HEADER_BYTES = 3       # 1 byte pad bits + 2 bytes big-endian length


def ratio(original: Column, compressed: Column) -> Column:
    """original / compressed, 0 when either is 0."""
    return F.when((original != 0) & (compressed != 0), original / compressed).otherwise(F.lit(0.0))


def rate(original: Column, compressed: Column) -> Column:
    """compressed / original, 0 when either is 0."""
    return F.when((original != 0) & (compressed != 0), compressed / original).otherwise(F.lit(0.0))


def metric_totals(stats: DataFrame, comp: str = "compressed_bytes", orig: str = "original_bytes",
                  extra_bytes: int = 0, set_total_length: int = 0) -> DataFrame:
    """Totals of both lengths (partial + final sum) and the ratio/rate pair.

    ``extra_bytes`` is added to the compressed total; a non-zero
    ``set_total_length`` replaces the original total, as the metric allows.
    """
    t = stats.agg(F.count(F.lit(1)).alias("n_items"), F.sum(comp).alias("compressed_bytes"),
                  F.sum(orig).alias("original_bytes"))
    c = F.col("compressed_bytes") + F.lit(extra_bytes)
    o = F.lit(set_total_length) if set_total_length else F.col("original_bytes")
    return t.select("n_items", c.alias("compressed_bytes"), o.alias("original_bytes"),
                    ratio(o, c).alias("ratio"), rate(o, c).alias("rate"))


def metric_rollup(stats: DataFrame, keys: list[str], comp: str = "compressed_bytes",
                  orig: str = "original_bytes") -> DataFrame:
    """Per-piece, per-group and overall totals in one pass (ROLLUP + grouping id)."""
    return stats.rollup(*keys).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum(orig).alias("original_bytes"),
        F.sum(comp).alias("compressed_bytes"),
    ).withColumn("ratio", ratio(F.col("original_bytes"), F.col("compressed_bytes")))


def running_sums(df: DataFrame, order: list[str], cols: list[str]) -> DataFrame:
    """Cumulative sums ``cum_<col>`` (current row included) in ``order``."""
    return running_agg(df, order, cols, "sum", True, "cum_")


def space_saved(original: Column, compressed: Column) -> Column:
    return F.when(original != 0, 100 * (1 - compressed / original)).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, pred: str, label: str, by: list[str] | None = None, total: bool = False) -> DataFrame:
    """Rows and share of correct predictions, per group; ``total`` adds the overall row (ROLLUP)."""
    acc = F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy")
    n = F.count(F.lit(1)).alias("n")
    return (df.rollup if total else df.groupBy)(*(by or [])).agg(n, acc)


def best_epoch(metrics: DataFrame, epoch: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Epoch with the best metric; a strict comparison keeps the first epoch on ties."""
    key = F.struct(F.col(metric) if higher_is_better else -F.col(metric), -F.col(epoch))
    return metrics.agg(F.max_by(epoch, key).alias("best_epoch"),
                       (F.max(metric) if higher_is_better else F.min(metric)).alias("best_value"))


def best_so_far(metrics: DataFrame, epoch: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Running best before each epoch and whether the epoch improved on it (one row per epoch)."""
    prev = running_agg(metrics, [epoch], [metric], "max" if higher_is_better else "min", inclusive=False,
                       prefix="_prev_")
    better = (F.col(metric) > F.col("prev_best")) if higher_is_better else (F.col(metric) < F.col("prev_best"))
    return prev.withColumnRenamed(f"_prev_{metric}", "prev_best").withColumn(
        "improved", F.col("prev_best").isNull() | better)
