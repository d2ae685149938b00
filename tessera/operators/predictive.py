"""Lossless coding driven by a plugged-in next-symbol predictor.

A predictor gives, for the bytes that many blocks have shown so far, the distribution of each block's next byte.
Blocks of a slice advance together, one predictor call a position. The encoder and the decoder make the
same calls on the same bytes and turn the answers into the same integer frequencies, so a predictor must
be a function of each row alone (not of the rows beside it). A checksum in every coded row makes a
predictor that differs between the two sides an error instead of wrong bytes.

A predictor that chooses among finitely many distributions may say so: ``rows`` are the distributions and
``which(seen)`` gives the row that holds for each block. Then it is asked for rows, and a row is turned into
frequencies once, not again for each byte.

``OrderTwo`` is the default predictor: the bytes after each pair of bytes, counted by Spark, mixed with the order-one model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.codec import M, decode_lanes, encode_lanes
from tessera.session import scratch_path

BLOCK_SYMBOLS = 2048
LANES = 512               # blocks that advance together, one lane group of the coder
ROWS = 4096               # distributions turned into frequencies at once
COUNTED = 1 << 22         # bytes counted at once
MIX = 4.0                 # weight of the order-one model, in counts


def integer_frequencies(p: np.ndarray) -> np.ndarray:
    """Rows of a distribution over 256 bytes as integers of at least 1 that sum to 2**16."""
    p = p / p.sum(axis=1, keepdims=True)
    f = 1 + np.floor((M - 256) * p).astype(np.int64)
    f[np.arange(len(f)), f.argmax(axis=1)] += M - f.sum(axis=1)
    return f


def _cumulative(rows: np.ndarray) -> np.ndarray:
    """Frequencies before each byte of each row, and 2**16 as the 257th, made in slices."""
    out = np.zeros((len(rows), 257), np.uint32)
    for at in range(0, len(rows), ROWS):
        out[at:at + ROWS, 1:] = np.cumsum(integer_frequencies(rows[at:at + ROWS].astype(np.float64)), axis=1)
    return out


class _Asked:
    """A predictor as the coder asks it: for each block a row of cumulative frequencies."""

    def __init__(self, predictor):
        self.predictor = predictor
        self.finite = _cumulative(predictor.rows) if hasattr(predictor, "which") else None

    def __call__(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat table of 257 columns, and where each block's row begins in it."""
        if self.finite is not None:
            return self.finite.reshape(-1), self.predictor.which(seen) * 257
        return _cumulative(self.predictor(seen)).reshape(-1), np.arange(len(seen)) * 257


def _by_length(sizes) -> np.ndarray:
    """The coder's order of lanes, longest first: those still going are always the first ones."""
    return np.argsort([-n for n in sizes], kind="stable")


class _Writing:
    """What a predictor says of known bytes, as the coder asks for it: last position first."""

    def __init__(self, ask: _Asked, seqs: list[bytes]):
        n, self.at = len(seqs), max(map(len, seqs), default=0)
        text = np.zeros((max(self.at, 1), n), np.uint8).T         # a position's bytes stand together
        order = _by_length(map(len, seqs))
        for i, o in enumerate(order.tolist()):
            text[i, :len(seqs[o])] = np.frombuffer(seqs[o], np.uint8)
        size = np.fromiter((-len(seqs[o]) for o in order), np.int64, n)
        self.freq, self.low = np.zeros((2, self.at, n), np.uint32)
        for t in range(self.at):
            k = int(np.searchsorted(size, -t))                   # blocks longer than t
            table, at = ask(text[:k, :t])
            at = at + text[:k, t]
            self.low[t, :k] = low = table[at]
            self.freq[t, :k] = table[at + 1] - low

    def intervals(self, lanes, c, s):
        self.at -= 1
        k = len(lanes)
        return self.freq[self.at, :k].astype(np.uint64), self.low[self.at, :k].astype(np.uint64)


class _Reading:
    """What a predictor says of the bytes decoded so far, first position first."""

    def __init__(self, ask: _Asked, n: int, longest: int):
        self.ask, self.text, self.t = ask, np.zeros((max(longest, 1), n), np.uint8).T, 0

    def symbols(self, lanes, c, slot):
        k = len(lanes)
        table, at = self.ask(self.text[:k, :self.t])
        slot = slot.astype(np.uint32)
        s = at.copy()
        for step in (128, 64, 32, 16, 8, 4, 2, 1):               # the last byte whose interval begins at or before the slot
            s += step * (table[s + step] <= slot)
        self.low = table[s]
        self.freq = table[s + 1] - self.low
        s = (s - at).astype(np.uint8)
        self.text[:k, self.t] = s
        self.t += 1
        return s

    def intervals(self, lanes, c, s):
        return self.freq.astype(np.uint64), self.low.astype(np.uint64)


def compress_predicted(blocks: DataFrame, predictor_factory: Callable, predictor_id: str, id_col: str = "doc_id") -> DataFrame:
    """Coded rows (id, block_no, predictor_id, n_symbols, crc, payload) of blocks (id, block_no, data) of any
    length. ``predictor_factory()`` runs once per Python worker task and gives the predictor."""

    def run(batches):
        ask = _Asked(predictor_factory())
        for pdf in batches:
            for at in range(0, len(pdf), LANES):
                part = pdf.iloc[at:at + LANES]
                data = [bytes(d) for d in part["data"]]
                yield pd.DataFrame({id_col: part[id_col], "block_no": part["block_no"], "predictor_id": predictor_id, "n_symbols": [len(d) for d in data],
                                    "crc": [zlib.crc32(d) for d in data], "payload": encode_lanes(data, _Writing(ask, data))})

    return blocks.select(id_col, "block_no", "data").mapInPandas(
        run, f"{id_col} long, block_no int, predictor_id string, n_symbols int, crc long, payload binary")


def decompress_predicted(coded: DataFrame, predictor_factory: Callable, predictor_id: str, id_col: str = "doc_id") -> DataFrame:
    """(id, block_no, data); rows coded with another predictor are an error, as are wrong bytes."""

    def run(batches):
        ask = _Asked(predictor_factory())
        for pdf in batches:
            other = pdf["predictor_id"] != predictor_id
            if other.any():
                raise ValueError(f"block coded with predictor {pdf.loc[other, 'predictor_id'].iloc[0]}, not {predictor_id}")
            for at in range(0, len(pdf), LANES):
                part = pdf.iloc[at:at + LANES]
                sizes = part["n_symbols"].tolist()
                data = decode_lanes([bytes(p) for p in part["payload"]], sizes, _Reading(ask, len(part), max(sizes)))
                if [zlib.crc32(d) for d in data] != part["crc"].tolist():
                    raise ValueError(f"predictor {predictor_id} gave other distributions than when the block was coded")
                yield pd.DataFrame({id_col: part[id_col], "block_no": part["block_no"], "data": data})

    return coded.select(id_col, "block_no", "predictor_id", "n_symbols", "crc", "payload").mapInPandas(run, f"{id_col} long, block_no int, data binary")


# ---------------------------------------------------------------- the default predictor

def count_pairs_and_next(data: DataFrame, col: str = "data") -> DataFrame:
    """(code, n): how often each three bytes follow each other, code = 65536 a + 256 b + c; before the first
    byte of a payload stand two zeros. At most 2**24 rows."""

    def counted(codes):
        n = np.bincount(np.concatenate(codes), minlength=1 << 24)
        code = np.flatnonzero(n)
        return pd.DataFrame({"code": code.astype(np.int32), "n": n[code]})

    def run(batches):
        for pdf in batches:
            codes, size = [], 0
            for raw in pdf["data"]:
                a = np.frombuffer(b"\0\0" + (raw or b""), np.uint8).astype(np.int32)
                codes.append(a[:-2] << 16 | a[1:-1] << 8 | a[2:])
                size += len(a)
                if size > COUNTED:
                    yield counted(codes)
                    codes, size = [], 0
            if codes:
                yield counted(codes)

    return data.select(F.col(col).alias("data")).mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def save_order_two(data: DataFrame, path: str | None = None) -> str:
    """Count and store the default predictor's table; returns its path."""
    path = path or scratch_path(data.sparkSession, "order-two")
    count_pairs_and_next(data).write.parquet(path)
    return path


class OrderTwo:
    """Distribution of the next byte from counts after the last two bytes, mixed with those after the last one."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        one = np.bincount(code & 0xFFFF, n, 1 << 16).reshape(256, 256)
        one = (one + 1 / 256) / (one.sum(axis=1, keepdims=True) + 1)
        contexts, which = np.unique(code >> 8, return_inverse=True)
        self.rows = np.empty((len(contexts) + 256, 256), np.float32)       # after two bytes, then after one
        self.rows[len(contexts):] = one
        for at in range(0, len(contexts), ROWS):
            part = MIX * one[contexts[at:at + ROWS] & 0xFF]
            own = slice(*np.searchsorted(which, (at, at + ROWS)))            # codes ascend, so contexts do
            part[which[own] - at, code[own] & 0xFF] += n[own]
            self.rows[at:at + len(part)] = part / part.sum(axis=1, keepdims=True)
        self.place = len(contexts) + (np.arange(1 << 16) & 0xFF)            # the row of each two bytes
        self.place[contexts] = np.arange(len(contexts))

    def which(self, seen: np.ndarray) -> np.ndarray:
        n, t = seen.shape
        b = seen[:, -1].astype(np.int64) if t else np.zeros(n, np.int64)
        return self.place[b if t < 2 else b | seen[:, -2].astype(np.int64) << 8]

    def __call__(self, seen: np.ndarray) -> np.ndarray:
        return self.rows[self.which(seen)].astype(np.float64)


def order_two(spark: SparkSession, path: str) -> tuple[Callable, str]:
    """(factory, id) of the stored predictor: its table goes to the workers once (at most 2**24 rows; about one
    in a hundred of them occur in text)."""
    t = spark.read.parquet(path).orderBy("code").toPandas()
    code, n = t["code"].to_numpy(np.int64), t["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((code, n))
    name = f"order-two-{zlib.crc32(code.tobytes() + n.tobytes()):08x}"
    return lambda: OrderTwo(*sent.value), name
