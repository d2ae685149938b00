"""Global order without a single-task window: consecutive ids, ranks, running aggregates.

Rows are range-partitioned by the order key, sorted inside each partition and *stored*
with their partition number and position. Every later use reads the same stored
numbers, so a recomputed exchange, a pruned column or another scan layout cannot move
a row. Ids and ranks depend on the keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

PART, POS = "__part", "__pos"


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` stored in ``order`` with its partition number and position in the partition.

    Equal keys share a partition, so ``order`` should end in a unique column: a hot key
    is then split like any other stretch of rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(rows.withColumn(PART, part).withColumn(
        POS, F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)), "ordered")


def assign_consecutive_ids(df: DataFrame, order: list[str], start: int | Column = 0, out: str = "chunk_id") -> DataFrame:
    """Ids start..start+n-1 in ``order``. One count per partition (as many rows as shuffle
    partitions) gives the partition offsets, which are broadcast."""
    rows = in_order(df, order)
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    start_c = start if isinstance(start, Column) else F.lit(start)
    return (rows.join(F.broadcast(offsets), PART)
            .withColumn(out, (F.col("__off") + F.col(POS) + start_c).cast("long"))
            .drop(PART, POS, "__off"))


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """0-based position in ``order`` (keys should be unique), distributed."""
    return assign_consecutive_ids(df, order, out=out)


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running_agg(df: DataFrame, order: list[str], cols: list[str], how: str = "sum", inclusive: bool = True,
                prefix: str = "cum_") -> DataFrame:
    """Running sum / max / min of ``cols`` in ``order`` without a single-partition window.

    Totals of the stored partitions get an exclusive running total over that small
    table (one row per shuffle partition) and are broadcast back; inside a partition a
    running window finishes the value. ``inclusive=False`` leaves the current row out.
    Any orderable key type works.
    """
    fn = _RUNNING[how]
    rows = in_order(df, order)
    tot = rows.groupBy(PART).agg(*[fn(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(PART, *[fn(f"_t_{c}").over(before).alias(f"_o_{c}") for c in cols])
    within = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(F.broadcast(offs), PART)
    for c in cols:
        o, w = F.col(f"_o_{c}"), fn(c).over(within)
        if how == "sum":
            v = F.when(o.isNull() & w.isNull(), F.lit(None)).otherwise(F.coalesce(o, F.lit(0)) + F.coalesce(w, F.lit(0)))
        else:
            v = (F.greatest if how == "max" else F.least)(o, w)   # both skip nulls
        out = out.withColumn(f"{prefix}{c}", v)
    return out.drop(PART, POS, *[f"_o_{c}" for c in cols])
