"""Lossless compression of whole tables: model training, integer frequencies,
lane-parallel rANS encode/decode, gzip jobs.

The model is an order-1 byte model (previous byte -> next byte) trained over the
corpus with Spark: each Arrow batch counts its byte pairs with numpy and a
``groupBy`` sums the partial counts. Counts are quantised in Spark to integer
frequencies that sum to 2**16 in every context (at least 1 per symbol), so
encoder and decoder use the very same table on every machine.

Coding is range asymmetric numeral systems (Duda, 2013) with a static model.
Documents are cut into blocks; inside an Arrow batch every block is one numpy
lane and all lanes advance one symbol per step, so the Python loop runs once
per symbol position, not once per symbol. A block row carries everything its
decoder needs: the model id, the symbol count and the payload.
"""

from __future__ import annotations

import gzip
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE_BITS = 16
M = 1 << SCALE_BITS           # frequencies sum to M in every context
RANS_L = 1 << 23              # lower bound of the coder state
BLOCK_BYTES = 16384           # symbols per block (the blob header allows up to 65,535)
LANE_GROUP = 1024             # blocks advanced together
GZIP_LEVEL = 9


# ---------------------------------------------------------------- model

def _pair_counts(batches):
    for pdf in batches:
        counts = np.zeros(256 * 256, dtype=np.int64)
        for b in pdf["data"]:
            a = np.frombuffer(b, dtype=np.uint8)
            if a.size == 0:
                continue
            prev = np.empty_like(a)
            prev[0] = 0
            prev[1:] = a[:-1]
            # a block starts with context 0, as the coder does
            prev[::BLOCK_BYTES] = 0
            counts += np.bincount(prev.astype(np.int64) * 256 + a, minlength=65536)
        nz = np.nonzero(counts)[0]
        yield pd.DataFrame({"pair": nz.astype(np.int32), "n": counts[nz]})


def train_byte_model(data: DataFrame, col: str = "data") -> DataFrame:
    """(ctx, sym, n, freq, cum): quantised order-1 byte model; 65,536 rows, always."""
    spark = data.sparkSession
    partial = data.select(F.col(col).alias("data")).mapInPandas(_pair_counts, "pair int, n long")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    grid = spark.range(65536).select(F.col("id").cast("int").alias("pair"))
    t = grid.join(counts, "pair", "left").fillna(0, ["n"]).select(
        (F.col("pair") / 256).cast("int").alias("ctx"), (F.col("pair") % 256).alias("sym"), "n")
    w = Window.partitionBy("ctx")
    n_ctx = F.sum("n").over(w)
    base = F.when(n_ctx > 0, 1 + F.floor(F.lit(M - 256) * F.col("n") / n_ctx)).otherwise(F.lit(M // 256))
    t = t.withColumn("f0", base.cast("long"))
    top = F.row_number().over(w.orderBy(F.col("n").desc(), F.col("sym")))
    rest = F.lit(M) - F.sum("f0").over(w)
    t = t.withColumn("freq", F.when(top == 1, F.col("f0") + rest).otherwise(F.col("f0")))
    before = w.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("cum", F.coalesce(F.sum("freq").over(before), F.lit(0))).select(
        "ctx", "sym", "n", "freq", "cum")


class ByteModel:
    """Frequency and cumulative tables as numpy arrays, plus a content id."""

    def __init__(self, freq: np.ndarray, cum: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = cum.astype(np.uint64)
        self.model_id = hashlib.sha256(freq.astype(np.uint32).tobytes()).hexdigest()[:16]
        self._slots = None

    @classmethod
    def from_table(cls, table: DataFrame) -> "ByteModel":
        # exactly 65,536 rows: a fixed, proven bound
        pdf = table.select("ctx", "sym", "freq", "cum").toPandas()
        freq = np.zeros((256, 256), np.int64)
        cum = np.zeros((256, 256), np.int64)
        freq[pdf.ctx, pdf.sym] = pdf.freq
        cum[pdf.ctx, pdf.sym] = pdf.cum
        if not (freq.sum(axis=1) == M).all() or (freq < 1).any():
            raise ValueError("model frequencies must be >= 1 and sum to 2**16 per context")
        return cls(freq, cum)

    def to_rows(self) -> pd.DataFrame:
        """(model_id, ctx, sym, freq, cum): 65,536 rows."""
        ctx, sym = np.divmod(np.arange(65536), 256)
        return pd.DataFrame({"model_id": self.model_id, "ctx": ctx.astype(np.int32), "sym": sym.astype(np.int32),
                             "freq": self.freq[ctx, sym].astype(np.int64), "cum": self.cum[ctx, sym].astype(np.int64)})

    def slot_table(self) -> np.ndarray:
        if self._slots is None:
            f = self.freq.astype(np.int64)
            self._slots = np.stack([np.repeat(np.arange(256, dtype=np.uint8), f[c]) for c in range(256)])
        return self._slots

    def intervals(self, lanes, c, s):
        """Frequency and lower end of symbol s after byte c."""
        return self.freq[c, s], self.cum[c, s]

    def symbols(self, lanes, c, slot):
        return self.slot_table()[c, slot]


class LaneModels:
    """One byte model for each lane: the corpus model mixed with the byte pairs of the lane's context.

    P = lam * P_context + (1 - lam) * P_corpus, P_context(b|a) = (c(a,b) + 1) / (c(a) + 256), as integer
    frequencies that sum to 2**16: built from the same bytes, encoder and decoder have the same table.
    """

    def __init__(self, base: ByteModel, contexts: list, lam: float):
        self.freq = np.empty((len(contexts), 256, 256), np.uint64)
        corpus = base.freq.astype(np.float64) / M
        for i, text in enumerate(contexts):
            a = np.frombuffer(text, np.uint8).astype(np.int64)
            n = np.bincount(a[:-1] * 256 + a[1:], minlength=65536).reshape(256, 256)
            p = lam * (n + 1) / (n.sum(axis=1, keepdims=True) + 256) + (1 - lam) * corpus
            f = 1 + np.floor((M - 256) * p).astype(np.int64)
            f[np.arange(256), f.argmax(axis=1)] += M - f.sum(axis=1)
            self.freq[i] = f
        self.cum = np.cumsum(self.freq, axis=2) - self.freq

    def intervals(self, lanes, c, s):
        return self.freq[lanes, c, s], self.cum[lanes, c, s]

    def symbols(self, lanes, c, slot):
        return ((self.cum[lanes, c] <= slot[:, None]).sum(axis=1) - 1).astype(np.uint8)


# ---------------------------------------------------------------- rANS lanes

def encode_lanes(seqs: list, model: ByteModel) -> list:
    """Encode byte strings in parallel lanes; returns one payload (bytes) per input. A model of more than
    256 symbols has a wider ``symbol_type``; its inputs are arrays of that type as bytes."""
    kind = np.dtype(getattr(model, "symbol_type", np.uint8))
    out_payloads = [b""] * len(seqs)
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    for g in range(0, len(order), LANE_GROUP):
        idx = order[g:g + LANE_GROUP]
        lens = np.array([len(seqs[i]) // kind.itemsize for i in idx], dtype=np.int64)
        n, T = len(idx), int(lens.max(initial=0))
        S = np.zeros((n, max(T, 1)), kind)
        for r, i in enumerate(idx):
            S[r, :lens[r]] = np.frombuffer(seqs[i], dtype=kind)
        P = np.zeros_like(S)
        P[:, 1:] = S[:, :-1]
        x = np.full(n, RANS_L, dtype=np.uint64)
        cap = 2 * T + 8
        buf = np.zeros((n, cap), np.uint8)
        ptr = np.full(n, cap, dtype=np.int64)
        active = 0
        for t in range(T - 1, -1, -1):
            # lanes are sorted by length, longest first: a lane joins once t < its length
            while active < n and lens[active] > t:
                active += 1
            k = active
            s, c = S[:k, t], P[:k, t]
            f, low = model.intervals(idx[:k], c, s)
            xmax = np.uint64((RANS_L >> SCALE_BITS) << 8) * f
            xs = x[:k]
            for _ in range(2):
                m = np.nonzero(xs >= xmax)[0]
                if m.size == 0:
                    break
                ptr[m] -= 1
                buf[m, ptr[m]] = (xs[m] & np.uint64(0xFF)).astype(np.uint8)
                xs[m] >>= np.uint64(8)
            x[:k] = ((xs // f) << np.uint64(SCALE_BITS)) + (xs % f) + low
        for _ in range(4):
            ptr -= 1
            buf[np.arange(n), ptr] = (x & np.uint64(0xFF)).astype(np.uint8)
            x >>= np.uint64(8)
        for r, i in enumerate(idx):
            out_payloads[i] = buf[r, ptr[r]:].tobytes()
    return out_payloads


def decode_lanes(payloads: list, lengths: list, model: ByteModel) -> list:
    """Decode payloads of known symbol counts in parallel lanes."""
    kind = np.dtype(getattr(model, "symbol_type", np.uint8))
    result = [b""] * len(payloads)
    order = np.argsort([-n for n in lengths], kind="stable")
    for g in range(0, len(order), LANE_GROUP):
        idx = order[g:g + LANE_GROUP]
        lens = np.array([lengths[i] for i in idx], dtype=np.int64)
        n, T = len(idx), int(lens.max(initial=0))
        width = max(len(payloads[i]) for i in idx) + 2
        B = np.zeros((n, width), np.uint8)
        for r, i in enumerate(idx):
            p = np.frombuffer(payloads[i], dtype=np.uint8)
            B[r, :p.size] = p
        x = np.zeros(n, dtype=np.uint64)
        for j in range(4):
            x = (x << np.uint64(8)) | B[:, j].astype(np.uint64)
        pos = np.full(n, 4, dtype=np.int64)
        out = np.zeros((n, max(T, 1)), kind)
        prev = np.zeros(n, kind)
        active = n
        for t in range(T):
            while active > 0 and lens[active - 1] <= t:
                active -= 1
            k = active
            xs = x[:k]
            c = prev[:k]
            slot = xs & np.uint64(M - 1)
            s = model.symbols(idx[:k], c, slot)
            f, low = model.intervals(idx[:k], c, s)
            xs = f * (xs >> np.uint64(SCALE_BITS)) + slot - low
            for _ in range(2):
                m = np.nonzero(xs < np.uint64(RANS_L))[0]
                if m.size == 0:
                    break
                xs[m] = (xs[m] << np.uint64(8)) | B[m, pos[m]].astype(np.uint64)
                pos[m] += 1
            x[:k] = xs
            out[:k, t] = s
            prev[:k] = s
        for r, i in enumerate(idx):
            result[i] = out[r, :lens[r]].tobytes()
    return result


# ---------------------------------------------------------------- table jobs

def to_blocks(data: DataFrame, id_col: str, col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, block_no, data): payloads cut into fixed-size binary blocks (narrow). An empty or null
    payload is one empty block, so it comes back as an empty payload."""
    x = data.select(id_col, F.coalesce(F.col(col), F.lit(b"").cast("binary")).alias("_d"))
    n = F.greatest(F.ceil(F.octet_length("_d") / block_bytes).cast("int"), F.lit(1))
    x = x.select(id_col, "_d", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    return x.select(id_col, "block_no", F.substring("_d", F.col("block_no") * block_bytes + 1, block_bytes).alias("data"))


def compress_blocks(blocks: DataFrame, model: ByteModel, id_col: str) -> DataFrame:
    """(id, block_no, model_id, n_symbols, payload, n_bytes) via mapInPandas over Arrow batches."""
    spark = blocks.sparkSession
    bc = spark.sparkContext.broadcast(model)
    mid = model.model_id

    def enc(batches):
        m = bc.value
        for pdf in batches:
            data = [bytes(b) for b in pdf["data"]]
            pay = encode_lanes(data, m)
            yield pd.DataFrame({id_col: pdf[id_col], "block_no": pdf["block_no"], "model_id": mid,
                                "n_symbols": [len(d) for d in data], "payload": pay,
                                "n_bytes": [len(p) for p in pay]})

    schema = f"{id_col} long, block_no int, model_id string, n_symbols int, payload binary, n_bytes int"
    return blocks.mapInPandas(enc, schema)


def decompress_blocks(blocks: DataFrame, model: ByteModel, id_col: str) -> DataFrame:
    """(id, block_no, data) from compressed blocks; rejects blocks of another model."""
    spark = blocks.sparkSession
    bc = spark.sparkContext.broadcast(model)
    mid = model.model_id

    def dec(batches):
        m = bc.value
        for pdf in batches:
            bad = pdf["model_id"] != mid
            if bad.any():
                raise ValueError(f"block coded with model {pdf.loc[bad, 'model_id'].iloc[0]}, not {mid}")
            data = decode_lanes([bytes(p) for p in pdf["payload"]], list(pdf["n_symbols"]), m)
            yield pd.DataFrame({id_col: pdf[id_col], "block_no": pdf["block_no"], "data": data})

    return blocks.select(id_col, "block_no", "model_id", "n_symbols", "payload").mapInPandas(
        dec, f"{id_col} long, block_no int, data binary")


def merge_blocks(blocks: DataFrame, id_col: str, col: str = "data") -> DataFrame:
    """(id, data): blocks concatenated in block order (one output row per document)."""
    return blocks.groupBy(id_col).agg(F.expr(f"listagg({col}) WITHIN GROUP (ORDER BY block_no)").alias(col))


# ---------------------------------------------------------------- conditioned on retrieved context

CONTEXT_LANES = 32            # rows coded together: each has a table of its own (1 MB in use)


def _conditioned(rows: DataFrame, model: ByteModel, lam: float, schema: str, work) -> DataFrame:
    """``work(models, part)`` over slices of at most CONTEXT_LANES rows that have a ``context`` column."""
    bc = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), CONTEXT_LANES):
                part = pdf.iloc[at:at + CONTEXT_LANES]
                contexts = [b"" if c is None else str(c).encode() for c in part["context"]]
                yield work(LaneModels(bc.value, contexts, lam), part)

    return rows.mapInPandas(run, schema)


def compress_with_context(rows: DataFrame, model: ByteModel, id_col: str, lam: float = 0.25) -> DataFrame:
    """Blocks (id, context_ids, model_id, lam, n_symbols, payload) of rows (id, data, context_ids, context).
    The context steers the model and is not coded itself: a decoder looks it up by its ids."""
    mid = model.model_id

    def work(models, part):
        data = [bytes(d) for d in part["data"]]
        return pd.DataFrame({id_col: part[id_col], "context_ids": part["context_ids"], "model_id": mid, "lam": lam,
                             "n_symbols": [len(d) for d in data], "payload": encode_lanes(data, models)})

    return _conditioned(rows.select(id_col, "data", "context_ids", "context"), model, lam,
                        f"{id_col} long, context_ids array<long>, model_id string, lam double, n_symbols int, payload binary", work)


def decompress_with_context(blocks: DataFrame, model: ByteModel, id_col: str, lam: float = 0.25) -> DataFrame:
    """(id, data) of blocks joined with their ``context`` again; rejects blocks of another model or weight."""
    mid = model.model_id

    def work(models, part):
        if (part["model_id"] != mid).any() or (part["lam"] != lam).any():
            raise ValueError(f"a block was not coded with model {mid} and weight {lam}")
        return pd.DataFrame({id_col: part[id_col], "data": decode_lanes([bytes(p) for p in part["payload"]], list(part["n_symbols"]), models)})

    return _conditioned(blocks.select(id_col, "model_id", "lam", "n_symbols", "payload", "context"), model, lam, f"{id_col} long, data binary", work)


# ---------------------------------------------------------------- gzip

@F.pandas_udf(T.BinaryType())
def gzip_bytes(s: pd.Series) -> pd.Series:
    """gzip level 9 with mtime 0, so output bytes are reproducible. Null stays null."""
    return s.map(lambda b: None if b is None else gzip.compress(bytes(b), compresslevel=GZIP_LEVEL, mtime=0))


@F.pandas_udf(T.BinaryType())
def gunzip_bytes(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else gzip.decompress(bytes(b)))
