"""Continue prompts with the bigram model until the stop symbol or a length limit.

All prompts advance together: one step joins every open prompt's last symbol with the
model's sampling intervals, so the model may be of any size and no symbol loop runs in
Python. Draws are hashes of (prompt id, step): a rerun or a recomputed partition
generates the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.hints import bounded_broadcast
from tessera.session import stored

STOP = "\n"
SEED = 0
STEPS_PER_ROUND = 8       # joins planned together; the state is stored between rounds


def sampling_intervals(model: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(a, choices): per context the symbols with the upper ends of their intervals in (0, 1],
    in symbol order; a context has at most as many choices as the alphabet has symbols."""
    w = model.select("a", "b", F.pow(F.col("n_ab").cast("double"), 1.0 / temperature).alias("w"))
    part = Window.partitionBy("a")
    upto = F.sum("w").over(part.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(part)
    return (w.withColumn("hi", upto).groupBy("a")
            .agg(F.array_sort(F.collect_list(F.struct("hi", "b"))).alias("choices")))


def generate(prompts: DataFrame, model: DataFrame, max_new: int = 64, temperature: float = 1.0,
             seed: int = SEED) -> DataFrame:
    """(id, generated, n_generated, stopped) for prompts (id, prompt). A context the model has not
    seen ends the text without ``stopped``."""
    table = bounded_broadcast(stored(sampling_intervals(model, temperature), "sampling"))
    last = F.when(F.length("prompt") > 0, F.substring("prompt", -1, 1)).otherwise(F.lit(STOP))
    state = prompts.select("id", F.coalesce(last, F.lit(STOP)).alias("a"), F.lit("").alias("generated"),
                           F.lit(True).alias("going"), F.lit(False).alias("stopped"))
    for step in range(max_new):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(step))))
        u = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)
        pick = F.element_at(F.filter("choices", lambda c: (c.hi > u) | (c.hi >= 1.0)), 1).b
        state = state.join(table, "a", "left").withColumn("_n", F.when(F.col("going") & F.col("choices").isNotNull(), pick))
        ends = F.col("going") & (F.col("_n") == STOP)
        grows = F.col("_n").isNotNull() & (F.col("_n") != STOP)
        state = state.select(
            "id", F.when(grows, F.col("_n")).otherwise(F.col("a")).alias("a"),
            F.when(grows, F.concat("generated", "_n")).otherwise(F.col("generated")).alias("generated"),
            grows.alias("going"), (F.col("stopped") | F.coalesce(ends, F.lit(False))).alias("stopped"))
        if step % STEPS_PER_ROUND == STEPS_PER_ROUND - 1 and step + 1 < max_new:
            state = stored(state, "generate")
    return state.select("id", "generated", F.length("generated").alias("n_generated"), "stopped")
