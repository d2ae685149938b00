"""Byte-feature classification: hashed byte n-grams with Spark ML's logistic regression, and byte pairs
with a classifier whose parameters are counts (training is an aggregation, prediction a join)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.plans.hints import bounded_broadcast
from tessera.session import scratch_path, stored

NUM_FEATURES = 1 << 14


def _hashes(grams: np.ndarray) -> np.ndarray:
    """Feature of each byte n-gram (one a row): HashingTF's MurmurHash3 (seed 42) of its tokens as NGram joins them, the
    two hex digits of each byte with a space between, modulo the features."""
    digits = np.frombuffer(b"0123456789ABCDEF", np.uint8)
    text = np.full((len(grams), 3 * grams.shape[1]), ord(" "), np.uint8)
    text[:, 0::3], text[:, 1::3] = digits[grams >> 4], digits[grams & 15]
    size = text.shape[1] - 1
    rot = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    mix = lambda k: rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    word = lambda at, n: sum((text[:, at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(n)), np.zeros(len(text), np.uint32))
    h = np.full(len(text), 42, np.uint32)
    for at in range(0, size - 3, 4):
        h = rot(h ^ mix(word(at, 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if size % 4:
        h ^= mix(word(size - size % 4, size % 4))
    h ^= np.uint32(size)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % NUM_FEATURES


@cache
def _table(n: int) -> np.ndarray:
    """The features of all n-grams of one or two bytes."""
    return _hashes(np.stack([np.arange(256 ** n) >> 8 * i & 255 for i in range(n - 1, -1, -1)], axis=1).astype(np.uint8))


def _gram_features(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of one payload's n-grams, ascending, and how often each occurs."""
    a = np.frombuffer(raw, np.uint8)
    if n <= 2:
        feature = _table(n)[a if n == 1 else a[:-1].astype(np.int32) << 8 | a[1:]]
    else:
        feature = _hashes(np.lib.stride_tricks.sliding_window_view(a, n) if len(a) >= n else np.zeros((0, n), np.uint8))
    tf = np.bincount(feature, minlength=NUM_FEATURES)
    on = np.flatnonzero(tf)
    return on, tf[on]


def byte_features(df: DataFrame, content: str, n: int = 2) -> DataFrame:
    """``df`` without ``content``, stored, with ``_tf``: the hashed counts of each payload's byte n-grams as a sparse vector,
    counted where the payload is read. Training and prediction read the vectors, the payloads once."""
    src = df.withColumn("_content", F.coalesce(F.col(content), F.lit(b"").cast("binary"))).drop(content)
    keep = [c for c in src.columns if c != "_content"]
    path = scratch_path(df.sparkSession, "byte-features")
    plain = StructType([*src.drop("_content").schema, StructField("_tf", VectorUDT.sqlType())])
    lists = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            found = [_gram_features(raw, n) for raw in b.column("_content").to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(f) for f, _ in found)]), pa.int32())
            at, tf = ([np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0)])
            vectors = pa.StructArray.from_arrays([pa.array(np.zeros(len(found), np.int8)), pa.array(np.full(len(found), NUM_FEATURES, np.int32)),
                                                  pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                                                  pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.float64)))], fields=list(lists))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), vectors], names=[*keep, "_tf"])

    src.mapInArrow(run, plain).write.parquet(path)
    return df.sparkSession.read.schema(StructType([*plain[:-1], StructField("_tf", VectorUDT())])).parquet(path)


def fit_classifier(train: DataFrame, content: str, label: str, n: int = 2, max_iter: int = 30):
    """Pipeline: hashed counts of byte n-grams (``byte_features``, here unless ``train`` has them) -> idf -> multinomial logistic regression."""
    x = train if "_tf" in train.columns else byte_features(train, content, n)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=0.01),
    ])
    return pipe.fit(x)


def predict(model, df: DataFrame, content: str, n: int = 2) -> DataFrame:
    return model.transform(df if "_tf" in df.columns else byte_features(df, content, n))


# ---------------------------------------------------------------- byte pairs by counts

PAIRS = 1 << 16           # possible byte pairs: the smoothing's vocabulary


@dataclass
class CountModel:
    """Sufficient statistics: occurrences of each byte pair in each class, and the classes' totals."""
    seen: DataFrame       # pair, label, n
    classes: DataFrame    # label, n_rows, n_pairs


def byte_pair_counts(df: DataFrame, keep: list[str], content: str) -> DataFrame:
    """``keep``, pair (256 a + b), n: the byte pairs of each payload, counted where it is read."""
    src = df.select(*keep, F.coalesce(F.col(content), F.lit(b"").cast("binary")).alias("_content"))
    out = src.drop("_content").withColumns({"pair": F.lit(0), "n": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in batches:
            rows, pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i, raw in enumerate(b.column("_content").to_pylist()):
                a = np.frombuffer(raw, np.uint8).astype(np.int32)
                pair, n = np.unique(a[:-1] << 8 | a[1:], return_counts=True)
                rows.append(np.full(len(pair), i))
                pairs.append(pair)
                counts.append(n)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), pa.array(np.concatenate(pairs), pa.int32()), pa.array(np.concatenate(counts))],
                                             names=[*keep, "pair", "n"])

    return src.mapInArrow(run, out)


def fit_counts(train: DataFrame, content: str, label: str) -> CountModel:
    """The stored model of the labelled rows; rows without a label teach nothing."""
    rows = train.where(F.col(label).isNotNull())
    seen = stored(byte_pair_counts(rows, [label], content).groupBy("pair", F.col(label).alias("label")).agg(F.sum("n").alias("n")), "pair-counts")
    n_pairs = seen.groupBy("label").agg(F.sum("n").alias("n_pairs"))
    classes = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows")).join(n_pairs, "label", "left").fillna(0, ["n_pairs"])
    return CountModel(seen, stored(classes, "classes"))


def predict_counts(model: CountModel, df: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, predicted): the class of largest ln P(class) + sum of n ln((n(pair, class) + 1) / (n(class) + 65536)); ties go
    to the smaller label. Classes are few (one array), ids unique."""
    counts = stored(byte_pair_counts(df, [id_col], content), "pair-counts")
    known = bounded_broadcast(model.seen.select("pair", "label", F.log(F.col("n") + 1.0).alias("w")))
    part = counts.join(known, "pair").groupBy(id_col, "label").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    part = part.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("s"))
    size = counts.groupBy(id_col).agg(F.sum("n").alias("n"))
    total = F.lit(float(model.classes.agg(F.sum("n_rows")).first()[0] or 1))
    classes = model.classes.select(F.sort_array(F.collect_list(F.struct("label", F.log(F.col("n_rows") / total).alias("prior"), F.log(F.col("n_pairs") + float(PAIRS)).alias("per"))))).scalar()
    scored = df.select(id_col).join(size, id_col, "left").join(part, id_col, "left").withColumn("classes", classes)
    score = F.transform("classes", lambda c: F.struct((c.prior - F.coalesce("n", F.lit(0)) * c.per + F.coalesce(F.col("s")[c.label], F.lit(0.0))).alias("score"), c.label.alias("label")))
    best = F.reduce(score, score[0], lambda a, x: F.when(x.score > a.score, x).otherwise(a))
    return scored.select(id_col, best["label"].alias("predicted"))
