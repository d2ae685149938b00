"""Coding with one model per kind of file, over bytes and a padding symbol.

Payloads are patches of 16 symbols, the last one padded with symbol 256. One pass over all pieces counts, for
each kind, the symbol pairs of a 257-symbol alphabet; a coded row names its kind, and its decoder takes
that kind's model. Kinds are file extensions: a model is 66,049 counts, whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bytes import PAD, PATCH_SIZE
from tessera.operators.codec import LANE_GROUP, M, decode_lanes, encode_lanes

SYMBOLS = PAD + 1
TYPE = np.dtype("<u2")


def padded(data: bytes) -> np.ndarray:
    """The symbols of a payload: its bytes, then padding to whole patches."""
    out = np.full(-(-len(data) // PATCH_SIZE) * PATCH_SIZE, PAD, TYPE)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out


def unpadded(symbols: np.ndarray) -> bytes:
    return symbols[symbols < PAD].astype(np.uint8).tobytes()


def count_symbols(pieces: DataFrame, kind: str = "kind", data: str = "data") -> DataFrame:
    """(kind, pair, n): symbol pairs of all pieces (before the first symbol stands 0), pair = 257 a + b."""

    def run(batches):
        for pdf in batches:
            for k, part in pdf.groupby("kind"):
                codes = [np.zeros(0, np.int64)]
                for d in part["data"]:
                    s = padded(bytes(d)).astype(np.int64)
                    codes.append(np.concatenate([[0], s[:-1]]) * SYMBOLS + s if len(s) else s)
                pair, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"kind": k, "pair": pair.astype(np.int32), "n": n})

    return pieces.select(F.col(kind).alias("kind"), F.col(data).alias("data")).mapInPandas(run, "kind string, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))


class KindModels:
    """Integer frequencies of every kind; lane i uses the model of kind ``of[i]``."""

    symbol_type = TYPE

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.place = {k: i for i, k in enumerate(sorted(counts))}
        self.freq = np.empty((len(counts), SYMBOLS, SYMBOLS), np.uint64)
        for k, (pair, n) in counts.items():
            c = np.bincount(pair, n, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
            p = (c + 1 / SYMBOLS) / (c.sum(axis=1, keepdims=True) + 1)
            f = 1 + np.floor((M - SYMBOLS) * p).astype(np.int64)
            f[np.arange(SYMBOLS), f.argmax(axis=1)] += M - f.sum(axis=1)
            self.freq[self.place[k]] = f
        self.cum = np.cumsum(self.freq, axis=2) - self.freq
        self.ids = {k: hashlib.sha256(self.freq[i].astype("<u4").tobytes()).hexdigest()[:16] for k, i in self.place.items()}

    def lanes(self, kinds: list[str]) -> "_Lanes":
        return _Lanes(self, np.array([self.place[k] for k in kinds]))


class _Lanes:
    symbol_type = TYPE

    def __init__(self, models: KindModels, of: np.ndarray):
        self.models, self.of = models, of

    def intervals(self, lanes, c, s):
        k = self.of[lanes]
        return self.models.freq[k, c, s], self.models.cum[k, c, s]

    def symbols(self, lanes, c, slot):
        return ((self.models.cum[self.of[lanes], c] <= slot[:, None]).sum(axis=1) - 1).astype(TYPE)


def load_models(spark: SparkSession, path: str) -> KindModels:
    """The models of the counts that ``count_symbols`` gave, stored under ``path``: 66,049 rows a kind at most."""
    pdf = spark.read.parquet(path).orderBy("kind", "pair").toPandas()
    return KindModels({k: (g["pair"].to_numpy(), g["n"].to_numpy()) for k, g in pdf.groupby("kind")})


def compress_pieces(pieces: DataFrame, models: KindModels, keep: list[str]) -> DataFrame:
    """``keep``, kind, model_id, n_symbols, payload of pieces (..., kind, data)."""
    sent = pieces.sparkSession.sparkContext.broadcast(models)
    schema = pieces.select(*keep, "kind").withColumns({"model_id": F.lit(""), "n_symbols": F.lit(0), "payload": F.lit(b"").cast("binary")}).schema

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), LANE_GROUP):
                part = pdf.iloc[at:at + LANE_GROUP].reset_index(drop=True)
                seqs = [padded(bytes(d)).tobytes() for d in part["data"]]
                out = part[[*keep, "kind"]].copy()
                out["model_id"] = [sent.value.ids[k] for k in part["kind"]]
                out["n_symbols"] = [len(s) // TYPE.itemsize for s in seqs]
                out["payload"] = encode_lanes(seqs, sent.value.lanes(part["kind"].tolist()))
                yield out

    return pieces.select(*keep, "kind", "data").mapInPandas(run, schema)


def decompress_pieces(coded: DataFrame, models: KindModels, keep: list[str]) -> DataFrame:
    """``keep``, kind, data; a row coded with another model of its kind is an error."""
    sent = coded.sparkSession.sparkContext.broadcast(models)
    schema = coded.select(*keep, "kind").withColumn("data", F.lit(b"").cast("binary")).schema

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), LANE_GROUP):
                part = pdf.iloc[at:at + LANE_GROUP].reset_index(drop=True)
                kinds = part["kind"].tolist()
                if [sent.value.ids.get(k) for k in kinds] != part["model_id"].tolist():
                    raise ValueError("a piece was coded with another model of its kind")
                out = part[[*keep, "kind"]].copy()
                data = decode_lanes([bytes(p) for p in part["payload"]], part["n_symbols"].tolist(), sent.value.lanes(kinds))
                out["data"] = [unpadded(np.frombuffer(d, TYPE)) for d in data]
                yield out

    return coded.select(*keep, "kind", "model_id", "n_symbols", "payload").mapInPandas(run, schema)
