"""Model hooks: any embedding model or next-symbol predictor plugs in here.

Both hooks run vectorised over Arrow batches. The embedding hook is an
iterator pandas UDF, so a model is loaded once per Python worker and reused for
every batch. The defaults need no model files and run on the JVM: hashed token
vectors (``hashed_embedding``) and a join with the corpus bigram model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import WORD_SPLIT, lower_words

EMBED_DIM = 256


def _bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def hashed_token_encoder(dim: int = EMBED_DIM) -> Callable[[list[str]], np.ndarray]:
    """Default encoder: lower-cased words hashed (md5) into ``dim`` buckets, L2-normalised."""
    import regex

    split = regex.compile(WORD_SPLIT.replace("(?U)", ""))

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float64)
        rows = [[w for w in split.split(t.lower()) if w] for t in texts]
        place = {w: _bucket(w, dim) for w in set().union(*rows)}       # each word of the batch hashed once
        for r, ws in enumerate(rows):
            out[r] = np.bincount([place[w] for w in ws], minlength=dim)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)

    return encode


def embed_udf(encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_token_encoder):
    """Iterator pandas UDF text -> array<double>; ``encoder_factory`` runs once per worker."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder_factory()
        for s in batches:
            m = enc(s.fillna("").tolist())
            yield pd.Series(list(m))

    return embed


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = EMBED_DIM, out: str = "embedding") -> DataFrame:
    """(id, embedding array<double>): the default encoder as joins and aggregates on the JVM.

    Lower-cased words are hashed (md5) into ``dim`` buckets and counted where the row is read;
    a row's vector has at most ``dim`` entries. Texts without words give the zero vector.
    """
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dim
    words = df.select(F.col(id_col).alias("_id"), F.explode(lower_words(text_col)).alias("w"))
    n = words.select("_id", bucket.cast("int").alias("i")).groupBy("_id", "i").agg(F.count(F.lit(1)).alias("n"))
    v = n.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"),
                             F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i] / F.col("norm"), F.lit(0.0)))
    return df.select(id_col).join(v.withColumnRenamed("_id", id_col), id_col, "left").select(id_col, dense.alias(out))


def bigram_predictor(model: DataFrame, max_bytes: int | None = None) -> Callable:
    """Predictor factory of the bigram ``model``: its table goes to the workers, which is refused beyond the broadcast
    bound (the join form of ``predict_symbols`` has no such bound)."""
    from tessera.operators.lm import context_totals
    from tessera.plans.hints import BROADCAST_BYTES, estimated_bytes

    table = model.select("a", "b", "p")
    if estimated_bytes(table) > (max_bytes or BROADCAST_BYTES):
        raise ValueError("the model is too large for a worker; join it instead")
    pairs = {r.a + r.b: r.p for r in table.collect()}
    contexts = {r.a: r.n_a + r.vocab for r in context_totals(model).collect()}
    vocab = model.agg(F.max("vocab")).first()[0] or 1
    sent = model.sparkSession.sparkContext.broadcast((pairs, contexts, vocab))

    def factory():
        seen, totals, v = sent.value

        def price(pair: str) -> float:
            p = seen.get(pair)
            return 1 / totals.get(pair[0], v) if p is None else p

        def predict(texts: list[str]) -> list[np.ndarray]:
            return [np.fromiter(map(price, map("".join, zip(t, t[1:]))), float, max(len(t) - 1, 0)) for t in texts]

        return predict

    return factory


def predicted_bits(docs: DataFrame, predictor_factory: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_coded, bits) of each document under a predictor: its probabilities are summed where the text is read, so
    no row per character leaves a task."""

    def run(batches):
        fn = predictor_factory()
        for pdf in batches:
            probs = [np.asarray(p, float) for p in fn(pdf[text_col].fillna("").tolist())]
            yield pd.DataFrame({id_col: pdf[id_col], "n_coded": [len(p) for p in probs], "bits": [float(-np.log2(p).sum()) for p in probs]})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, n_coded long, bits double")


def predict_symbols(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                    predictor_factory: Callable | None = None) -> DataFrame:
    """(id, pos, p): probability of each actual next character.

    ``predictor_factory()`` runs once per Python worker and returns a function from a list of
    texts to one float array per text (length - 1); it brings its own model. Without one the
    bigram ``model`` table is joined, unseen pairs included, at any model size.
    """
    if predictor_factory is None:
        from tessera.operators.lm import symbol_pairs, with_bits, with_characters
        pairs = with_characters(docs, [id_col], text_col).select(id_col, F.posexplode(symbol_pairs("_c")).alias("_i", "_p")).select(
            id_col, (F.col("_i") + 1).alias("pos"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
        return with_bits(pairs, model).select(id_col, "pos", "p")

    def run(batches):
        fn = predictor_factory()
        for pdf in batches:
            probs = [np.asarray(p, float) for p in fn(pdf[text_col].fillna("").tolist())]
            lengths = [len(p) for p in probs]
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), lengths),
                                "pos": np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in lengths] or [np.zeros(0, np.int32)]),
                                "p": np.concatenate(probs or [np.zeros(0)])})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, pos int, p double")
