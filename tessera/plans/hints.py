"""Join-side decisions made from sizes the planner already knows.

``broadcast()`` is only applied to a side whose size estimate (bytes of its stored
files, as pruned by the plan) is within a bound; otherwise the plain DataFrame is
returned and Spark plans the join itself, with AQE splitting skewed partitions. No
job runs for the decision, and both plans give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on the estimated bytes of a side we are willing to ship to every executor.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; very large where it has none (an RDD source)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its estimate is at most ``max_bytes``, else leave it to the planner."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df
