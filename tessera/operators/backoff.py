"""Variable-order text model: contexts of up to ``order`` characters, with back-off.

Every window of a text (the symbol and up to ``order`` characters before it) is counted once; lower orders
are sums over the counted windows. A context stays if it was seen ``min_count`` times; a context's suffix was
seen at least as often, so the kept contexts are closed under taking suffixes. Probabilities are interpolated by absolute discounting,

    P(s | c) = (n(c, s) - D) / n(c) + back_off(c) P(s | suffix of c),    back_off(c) = D distinct(c) / n(c),

level by level: each level is one join with the level below, whose empty end is 1 / (V + 1) for all symbols,
seen or not. Scoring walks the same levels up: a window's price is that of its longest kept context.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lm import window_counts
from tessera.plans.hints import bounded_broadcast
from tessera.session import scratch_path, stored

ORDER = 3
MIN_COUNT = 8
DISCOUNT = 0.75


@dataclass
class BackoffModel:
    entries: DataFrame     # level, ctx, sym, n, p
    contexts: DataFrame    # level, ctx, n_ctx, back_off
    order: int


def _suffix(ctx: str, level: int) -> Column:
    """The last ``level`` characters, null if there are fewer."""
    c = F.col(ctx)
    return F.when(F.char_length(c) >= level, F.right(c, F.lit(level)) if level else F.lit(""))


def train(corpus: DataFrame, text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> BackoffModel:
    """The stored model of a corpus."""
    top = stored(window_counts(corpus, [], text_col, order).groupBy("ctx", "sym").agg(F.sum("n").alias("n")), "window-counts")
    entries, contexts, below = [], [], None
    for level in range(order + 1):
        own = top.select(_suffix("ctx", level).alias("ctx"), "sym", "n").where("ctx is not null").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))
        ctx = stored(own.groupBy("ctx").agg(F.sum("n").alias("n_ctx"), F.count(F.lit(1)).alias("u")).where(F.col("n_ctx") >= (min_count if level else 1))
                     .withColumn("back_off", discount * F.col("u") / F.col("n_ctx")), "contexts")
        own = own.join(bounded_broadcast(ctx), "ctx")
        if level == 0:
            own = own.withColumn("lower", 1 / (F.col("u") + 1))
        else:
            less = bounded_broadcast(below.select(F.col("ctx").alias("_s"), "sym", F.col("p").alias("lower")))
            own = own.withColumn("_s", _suffix("ctx", level - 1)).join(less, ["_s", "sym"])
        below = stored(own.select(F.lit(level).alias("level"), "ctx", "sym", "n",
                                  ((F.col("n") - discount) / F.col("n_ctx") + F.col("back_off") * F.col("lower")).alias("p")), "backoff-entries")
        entries.append(below)
        contexts.append(ctx.select(F.lit(level).alias("level"), "ctx", "n_ctx", "back_off", "u"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return BackoffModel(union(entries), union(contexts), order)


def save(model: BackoffModel, path: str) -> None:
    model.entries.write.partitionBy("level").parquet(f"{path}/entries")
    model.contexts.write.partitionBy("level").parquet(f"{path}/contexts")


def load(spark: SparkSession, path: str) -> BackoffModel:
    entries, contexts = (spark.read.parquet(f"{path}/{t}") for t in ("entries", "contexts"))
    return BackoffModel(entries, contexts, contexts.agg(F.max("level")).first()[0] or 0)


def price(seen: DataFrame, model: BackoffModel) -> DataFrame:
    """``seen`` (ctx, sym, ...) with p, by joins from the empty context up."""
    empty = F.coalesce(model.contexts.where("level = 0").select(F.max("u")).scalar(), F.lit(0))
    out = seen.withColumn("p", 1 / (empty + 1))
    for level in range(model.order + 1):
        entry = bounded_broadcast(model.entries.where(F.col("level") == level).select(F.col("ctx").alias("_s"), "sym", F.col("p").alias("_p")))
        known = bounded_broadcast(model.contexts.where(F.col("level") == level).select(F.col("ctx").alias("_s"), "back_off"))
        out = (out.withColumn("_s", _suffix("ctx", level)).join(entry, ["_s", "sym"], "left").join(known, "_s", "left")
               .withColumn("p", F.coalesce("_p", F.coalesce("back_off", F.lit(1.0)) * F.col("p"))).drop("_s", "_p", "back_off"))
    return out


def document_bits(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_coded, bits) of every document; those without a coded symbol have none. Windows are counted where the
    document is read, so no task gathers those of many documents, and each distinct one is priced once."""
    counts = stored(window_counts(docs, [id_col], text_col, model.order), "document-windows")
    priced = stored(price(counts.select("ctx", "sym").distinct(), model), "priced-windows")
    per = counts.join(priced, ["ctx", "sym"]).groupBy(id_col).agg(F.sum("n").alias("n_coded"), F.sum(-F.col("n") * F.log2("p")).alias("bits"))
    return docs.select(id_col).join(per, id_col, "left").select(
        id_col, F.coalesce("n_coded", F.lit(0)).alias("n_coded"), F.coalesce("bits", F.lit(0.0)).alias("bits"))
