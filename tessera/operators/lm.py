"""Corpus language model as aggregations and joins.

The neural next-symbol predictor of the reference is replaced by an order-1
(bigram) model trained with ``groupBy``: P(b|a) = (c(a,b) + 1) / (c(a) + V),
V = number of distinct successor symbols. Scoring a document is then a join of
its symbol pairs with the model and a sum of -log2 P. The first symbol of a
document has no context and is not coded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.bytes import runs
from tessera.plans.hints import bounded_broadcast
from tessera.session import stored

# Fixed values that must equal the reference behaviour.
TOP_K_PROBE = 5                                   # top-5 membership check of the true symbol
SLICE_CHARS = 1 << 19                             # characters whose windows a task counts at once
FLOAT32_EPS = float(np.finfo(np.float32).eps)     # machine epsilon used by the pdf normaliser


def symbol_pairs(chars: str) -> Column:
    """Array of structs (a, b): each character with its successor. ``chars`` names a materialised
    character array (see ``with_characters``), so a text is split once."""
    c = F.col(chars)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.arrays_zip(F.slice(c, 1, n).alias("a"), F.slice(c, 2, n).alias("b"))


def with_characters(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns and ``_c``, the characters of the text."""
    return df.select(*keep, T.characters(text_col).alias("_c"))


def window_counts(df: DataFrame, keep: list[str], text_col: str, order: int = 1) -> DataFrame:
    """``keep`` columns, ctx (the up to ``order`` characters before), sym, n: the symbols but the first of each text, with
    their contexts, counted where the text is read. Rows are counted by themselves if ``keep`` names columns, else
    ``SLICE_CHARS`` characters of them together; a window can come in several rows. Memory is bounded by a slice, or by the longest text."""
    src = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = src.drop("_text").withColumns({"ctx": F.lit(""), "sym": F.lit(""), "n": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in batches:
            sizes = pc.utf8_length(b.column("_text")).to_numpy().astype(np.int64)
            for lo, hi in runs(np.cumsum(sizes), SLICE_CHARS):
                row, ctx, sym, n = _windows("".join(b.column("_text").slice(lo, hi - lo).to_pylist()), sizes[lo:hi], order, bool(keep))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row + lo)) for c in keep), ctx, sym, pa.array(n, pa.int64())], names=[*keep, "ctx", "sym", "n"])

    return src.mapInArrow(run, out)


def _distinct(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``key`` (all below ``top``) and their counts."""
    if top <= 8 * len(key):
        n = np.bincount(key, minlength=1)
        on = np.flatnonzero(n)
        return on, n[on]
    return np.unique(key, return_counts=True)


def _windows(text: str, sizes: np.ndarray, order: int, by_row: bool) -> tuple:
    """(row, ctx, sym, count) of the windows of texts given one after the other."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    present = np.zeros(int(code.max(initial=0)) + 2, bool)
    present[code] = True
    number = np.cumsum(present)[code]                    # from 1; 0 stands before a text
    most = int(present.sum()) + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place > 0)
    key, top = number[at], most
    for j in range(1, order + 1):
        if top > (1 << 62) // most:
            found, key = np.unique(key, return_inverse=True)
            top = len(found)
        key, top = key * most + np.where(place[at] >= j, number[at - j], 0), top * most
    values, _ = _distinct(key, top)
    first = np.zeros(len(values), np.int64)
    of = np.searchsorted(values, key) if top > 8 * len(key) else np.cumsum(np.bincount(values, minlength=top))[key] - 1
    first[of] = at
    pair = row[at] * len(values) + of if by_row else of
    pair, n = _distinct(pair, (len(sizes) if by_row else 1) * len(values))
    rows, kind = np.divmod(pair, max(len(values), 1))
    ends, starts = first.tolist(), (first - np.minimum(place[first], order)).tolist()
    ctx, sym = pa.array([text[s:e] for s, e in zip(starts, ends)], pa.string()), pa.array([text[e] for e in ends], pa.string())
    return rows, ctx.take(pa.array(kind)), sym.take(pa.array(kind)), n


def train_bigram(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Model table (a, b, n_ab, n_a, vocab, p, bits).

    Pairs are counted where the texts are read, then by a partial + final aggregation,
    so a hot pair is combined map-side before the shuffle. ``vocab`` is a scalar subquery.
    """
    counts = window_counts(corpus, [], text_col).groupBy(F.col("ctx").alias("a"), F.col("sym").alias("b")).agg(F.sum("n").alias("n_ab"))
    # The counts feed the vocabulary and several joins: stored once, one row per seen pair.
    counts = stored(counts, "bigram-counts")
    vocab = counts.select(F.count_distinct("b")).scalar()
    return with_probabilities(counts, vocab)


def with_probabilities(counts: DataFrame, vocab: Column) -> DataFrame:
    n_a = F.sum("n_ab").over(Window.partitionBy("a"))
    p = (F.col("n_ab") + 1) / (F.col("n_a") + F.col("vocab"))
    return (counts.withColumn("n_a", n_a).withColumn("vocab", vocab.cast("long"))
            .withColumn("p", p).withColumn("bits", -F.log2("p")))


def context_totals(model: DataFrame) -> DataFrame:
    """(a, n_a, vocab): one row per context, for pairs the model has not seen."""
    return model.groupBy("a").agg(F.first("n_a").alias("n_a"), F.first("vocab").alias("vocab"))


def with_bits(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``p`` and ``bits``. A pair the model has not seen gets
    1 / (c(a) + V), c(a) = 0 for a context it has not seen either: a held-out symbol is
    never dropped."""
    vocab = F.coalesce(model.select(F.max("vocab")).scalar(), F.lit(0))
    seen = bounded_broadcast(model.select("a", "b", F.col("p").alias("_p")))
    ctx = bounded_broadcast(context_totals(model).select("a", F.col("n_a").alias("_n")))
    p = F.coalesce(F.col("_p"), 1 / F.greatest(F.coalesce(F.col("_n"), F.lit(0)) + vocab, F.lit(1)))
    return (pairs.join(seen, ["a", "b"], "left").join(ctx, "a", "left")
            .withColumn("p", p).withColumn("bits", -F.log2("p")).drop("_p", "_n"))


def document_bits(docs: DataFrame, model: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_coded, bits): -sum log2 P over every coded symbol of each document.

    Symbol pairs are counted where the document is read, so no task gathers the pairs of many
    documents, then priced once per distinct pair. Documents without a coded symbol (null, empty or
    one character) have 0 symbols and 0 bits. Only ids and counts are shuffled.
    """
    pairs = window_counts(docs, [id_col], text_col).withColumnsRenamed({"ctx": "a", "sym": "b"})
    priced = with_bits(pairs, model)
    per = priced.groupBy(id_col).agg(F.sum("n").alias("n_coded"), F.sum(F.col("n") * F.col("bits")).alias("bits"))
    return docs.select(id_col).join(per, id_col, "left").select(
        id_col, F.coalesce("n_coded", F.lit(0)).alias("n_coded"), F.coalesce("bits", F.lit(0.0)).alias("bits"))


def pair_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, n): symbol pairs counted per document (context shifted by one)."""
    return window_counts(df, [id_col], text_col).groupBy(id_col, F.col("ctx").alias("a"), F.col("sym").alias("b")).agg(F.sum("n").alias("n"))


def symbol_cdf(model: DataFrame) -> DataFrame:
    """Integer cumulative interval [cum_lo, cum_hi) of each symbol in its context (symbol order)."""
    before = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("n_ab").over(before), F.lit(0))
    return model.select("a", "b", lo.alias("cum_lo"), (lo + F.col("n_ab")).alias("cum_hi"),
                        F.col("n_a").alias("total"))


def ranked(model: DataFrame) -> DataFrame:
    """Model with the rank of each symbol in its context: most probable first, ties by symbol."""
    w = Window.partitionBy("a").orderBy(F.col("n_ab").desc(), F.col("b"))
    return model.withColumn("sym_rank", F.row_number().over(w))


def topk_membership(docs: DataFrame, model: DataFrame, k: int = TOP_K_PROBE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_coded, n_in_topk, topk_rate): how often the true symbol is among the k most likely."""
    top = ranked(model).filter(F.col("sym_rank") <= k).select("a", "b", F.lit(1).alias("hit"))
    j = pair_counts(docs, id_col, text_col).join(bounded_broadcast(top), ["a", "b"], "left")
    per = j.groupBy(id_col).agg(F.sum("n").alias("n_coded"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_in_topk"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select(id_col).join(per, id_col, "left").select(id_col, z("n_coded"), z("n_in_topk")).withColumn(
        "topk_rate", F.round(F.try_divide("n_in_topk", "n_coded"), 6))


def nucleus_filter(model: DataFrame, top_p: float) -> DataFrame:
    """Smallest most-probable set per context whose cumulative p reaches ``top_p``.

    A symbol is kept when the mass of the symbols ranked before it is below top_p.
    """
    w = Window.partitionBy("a").orderBy(F.col("n_ab").desc(), F.col("b"))
    before = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    q = model.withColumn("q", F.col("n_ab") / F.col("n_a"))
    return q.withColumn("mass_before", before).filter(F.col("mass_before") < top_p)


def sample_distribution(model: DataFrame, temperature: float = 1.0, top_k: int = 0,
                        top_p: float = 1.0) -> DataFrame:
    """Sampling distribution per context: temperature, then top-k, then top-p, renormalised.

    top_k = 0 and top_p = 1 disable the filters, as in the reference defaults.
    """
    q = model.select("a", "b", "n_ab", "n_a", F.pow(F.col("n_ab") / F.col("n_a"), 1.0 / temperature).alias("w"))
    q = q.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("a")))
    order = Window.partitionBy("a").orderBy(F.col("w").desc(), F.col("b"))
    if top_k > 0:
        q = q.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k).drop("_r")
    if top_p < 1.0:
        before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        q = q.withColumn("_m", before).filter(F.col("_m") < top_p).drop("_m")
    return q.withColumn("p_sample", F.col("w") / F.sum("w").over(Window.partitionBy("a"))).drop("w")


def normalize_pdf(model: DataFrame, p_col: str = "p", eps: float = FLOAT32_EPS) -> DataFrame:
    """p / sum(p), then (1 - 2·V·eps)·p + eps per context (V = symbols in the context)."""
    w = Window.partitionBy("a")
    p = F.col(p_col) / F.sum(p_col).over(w)
    v = F.count(F.lit(1)).over(w)
    return model.withColumn("p_norm", (1 - 2 * v * F.lit(eps)) * p + F.lit(eps))


def quantize(model: DataFrame, total_bits: int = 16) -> DataFrame:
    """Integer frequencies per context summing to about 2**total_bits, each at least 1."""
    scale = float(1 << total_bits)
    return model.withColumn("freq", F.greatest(F.lit(1), F.floor(F.col("p") * scale)).cast("long"))


def prob_diff(model: DataFrame, total_bits: int = 16) -> DataFrame:
    """Per context: largest |p - freq/2^b| and |sum(freq)/2^b - 1| (encoder/decoder drift)."""
    q = quantize(model, total_bits).withColumn("pq", F.col("freq") / float(1 << total_bits))
    return q.groupBy("a").agg(
        F.max(F.abs(F.col("p") - F.col("pq"))).alias("max_abs_diff"),
        F.abs(F.sum("pq") - 1).alias("sum_error"))


def softmax_array(v) -> Column:
    """Softmax over an array of logits (numerically stable)."""
    def shares(ex):
        return T.bound(F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x), lambda s: F.transform(ex, lambda x: x / s))

    return T.bound(T.col_(v), lambda a: T.bound(F.array_max(a), lambda m: T.bound(F.transform(a, lambda x: F.exp(x - m)), shares)))


def rag_bits(items: DataFrame, contexts: DataFrame, model: DataFrame, lam: float = 0.25,
             id_col: str = "item_id", text_col: str = "text", ctx_col: str = "context") -> DataFrame:
    """Bits of each item without and with its retrieved context.

    P' = lam·P_ctx + (1-lam)·P with P_ctx(b|a) = (c_ctx(a,b)+1)/(c_ctx(a)+V): the
    context's own bigram counts, same smoothing. Only item symbols are coded.
    Pairs unseen by the corpus model get 1/(c(a)+V).
    """
    vocab = model.select(F.max("vocab")).scalar()
    ip = pair_counts(items, id_col, text_col)
    cp = pair_counts(contexts, id_col, ctx_col).withColumnRenamed("n", "c_ab")
    ca = cp.groupBy(id_col, "a").agg(F.sum("c_ab").alias("c_a"))
    corpus_a = context_totals(model).select("a", F.col("n_a").alias("m_a"))
    m = bounded_broadcast(model.select("a", "b", F.col("n_ab").alias("m_ab")))
    j = (ip.join(cp, [id_col, "a", "b"], "left").join(ca, [id_col, "a"], "left")
         .join(m, ["a", "b"], "left").join(bounded_broadcast(corpus_a), "a", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    p_base = (z("m_ab") + 1) / (z("m_a") + vocab)
    p_ctx = (z("c_ab") + 1) / (z("c_a") + vocab)
    p_mix = F.lit(lam) * p_ctx + F.lit(1 - lam) * p_base
    return j.groupBy(id_col).agg(
        F.sum("n").alias("n_coded"),
        F.sum(-F.col("n") * F.log2(p_base)).alias("bits_plain"),
        F.sum(-F.col("n") * F.log2(p_mix)).alias("bits_rag"),
    )
