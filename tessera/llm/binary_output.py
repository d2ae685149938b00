"""Token ids as length-delimited binary records with a separate offset index.

A data file is a row of records in ascending id order, each framed as in the TFRecord format:
length (8 bytes, little-endian), masked CRC-32C of the length, the payload, masked CRC-32C of
the payload. The payload is one serialized document: its key (presence byte and 8 bytes), its
token count (8 bytes) and its ids as LEB128 variable-length integers. Index rows
(file, offset, size, doc_id, n_tokens) form a Parquet table of their own, so shuffled reads
fetch any subset of records by position without scanning data files.

Each task writes the documents of one range of ids to one file: under a temporary name of its
attempt, then renamed, so a task that runs again replaces the file with equal bytes. Readers
check both checksums and raise on damage. Null text is an empty document (its end id only);
null ids come first; repeated ids follow each other by content; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_dir, open_fs, stored
from tessera.llm.tokens import encoder

END_ID = 2                  # fixed value
READ_BYTES = 8 << 20        # one read of the index-driven reader

# CRC-32C (Castagnoli), the checksum that this framing prescribes.
_POLY = 0x82F63B78


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLY), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()
_PAIR_TABLE = _TABLE[np.arange(1 << 16) & 0xFF]                      # two bytes at once
_PAIR_TABLE = _TABLE[(_PAIR_TABLE ^ (np.arange(1 << 16, dtype=np.uint32) >> 8)) & 0xFF] ^ (_PAIR_TABLE >> 8)
_STRIDE = 1 << 10


def _zero_operator(n: int) -> np.ndarray:
    """Matrix (32 columns) that carries a CRC register over n zero bytes."""
    cols = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = (cols >> 8) ^ _TABLE[cols & 0xFF]              # one zero byte
    out = cols.copy()
    while n:
        if n & 1:
            out = _apply(step, out)
        step = _apply(step, step)
        n >>= 1
    return out


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), op, np.uint32(0)), axis=1)


def crc32c_many(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part. The parts are cut into strides that advance together, two bytes a step,
    as numpy lanes; strides of one part are then combined by carrying over zero bytes."""
    if not parts:
        return []
    data = np.frombuffer(b"".join(parts) + b"\0\0", np.uint8)
    pairs = data[:-1] | data[1:].astype(np.uint32) << np.uint32(8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    lanes = np.maximum(1, -(-size // _STRIDE))
    owner = np.repeat(np.arange(len(parts)), lanes)
    k = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = np.repeat(np.cumsum(size) - size, lanes)
    # The first stride of a part is the short one, so that all later ones span _STRIDE bytes.
    head = size - (lanes - 1) * _STRIDE
    start = begin + np.where(k == 0, 0, head[owner] + (k - 1) * _STRIDE)
    length = np.where(k == 0, head[owner], _STRIDE)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    reg = np.where(k[order] == 0, np.uint32(0xFFFFFFFF), np.uint32(0))
    odd = np.flatnonzero(length & 1)
    reg[odd] = (reg[odd] >> 8) ^ _TABLE[(reg[odd] & 0xFF) ^ data[start[odd]]]
    start, steps = start + (length & 1), length >> 1                # steps fall from lane to lane
    for i, n in enumerate((len(order) - np.searchsorted(steps[::-1], np.arange(1, int(steps[0]) + 1), "left")).tolist()):
        r = reg[:n]
        reg[:n] = (r >> 16) ^ _PAIR_TABLE[(r & 0xFFFF) ^ pairs[start[:n] + 2 * i]]
    back = np.empty_like(reg)
    back[order] = reg
    crc = back[k == 0].copy()
    most = int(lanes.max())
    if most > 1:
        jump = _zero_operator(_STRIDE)
        first = np.cumsum(lanes) - lanes
        for step in range(1, most):
            on = np.flatnonzero(lanes > step)
            crc[on] = _apply(jump, crc[on]) ^ back[first[on] + step]
    return (crc ^ np.uint32(0xFFFFFFFF)).tolist()


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _varints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of 32-bit ids, and where each id ends."""
    size = 1 + (ids >= 1 << 7).astype(np.int64) + (ids >= 1 << 14) + (ids >= 1 << 21) + (ids >= 1 << 28)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(5):
        on = size > i
        if not on.any():
            break
        more = (size[on] > i + 1).astype(np.uint8) << 7
        out[end[on] - size[on] + i] = ((ids[on] >> np.uint32(7 * i)) & 0x7F).astype(np.uint8) | more
    return out, end


def _from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint32)
    for i in range(5):
        at = first + i
        on = np.flatnonzero(at <= last)
        if not len(on):
            break
        out[on] |= (raw[at[on]] & 0x7F).astype(np.uint32) << np.uint32(7 * i)
    return out


def serialize(keys: list[int | None], ids: list[np.ndarray]) -> list[bytes]:
    """One payload per document."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    body, end = _varints(np.concatenate([*ids, np.zeros(0, "<u4")]))
    cuts = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])].tolist()
    body = body.tobytes()
    return [struct.pack("<Bqq", k is not None, k or 0, m) + body[a:b] for k, m, a, b in zip(keys, n.tolist(), cuts, cuts[1:])]


def parse(payloads: list[bytes]) -> list[tuple[int | None, np.ndarray]]:
    """Keys and ids of payloads; raises ValueError if the ids are not those counted."""
    heads = [struct.unpack_from("<Bqq", p) for p in payloads]
    ids = _from_varints(np.frombuffer(b"".join(p[17:] for p in payloads), np.uint8))
    ends = np.cumsum([h[2] for h in heads])
    whole = all(len(p) == 17 or p[-1] < 128 for p in payloads)
    if not whole or len(ids) != (ends[-1] if len(ends) else 0):
        raise ValueError("token count differs from the record's")
    return [(k if there else None, ids[e - n:e]) for (there, k, n), e in zip(heads, ends.tolist())]


INDEX = "file string, offset long, size long, doc_id long, n_tokens long"
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                  tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs`` under ``folder``; returns the stored offset index."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
               .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    end = end_id.to_bytes(4, "little")

    def run(batches):
        fs, root = open_fs(folder)
        encode = encoder(tokenizer).encode_many
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.records"
        temp = f"{root}/.{uuid.uuid4().hex}.tmp"
        out, at, rows = None, 0, []
        for b in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temp)
            keys = b.column("doc_id").to_pylist()
            ids = [np.frombuffer(x + end, "<u4") for x in encode(b.column("text").to_pylist())]
            payloads = serialize(keys, ids)
            heads = [struct.pack("<Q", len(p)) for p in payloads]
            for key, i, p, h, hc, pc in zip(keys, ids, payloads, heads, crc32c_many(heads), crc32c_many(payloads)):
                frame = b"".join((h, struct.pack("<I", masked(hc)), p, struct.pack("<I", masked(pc))))
                out.write(frame)
                rows.append((name, at, len(frame), key, len(i)))
                at += len(frame)
        if out is not None:
            out.close()
            fs.move(temp, name)
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _INDEX_TYPES)],
                                             names=["file", "offset", "size", "doc_id", "n_tokens"])

    return stored(ordered.mapInArrow(run, INDEX), "records-index")


def read_records(index: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """Read the records that ``index`` (any subset or order of its rows) names and check them:
    file, offset, doc_id, n_tokens, ids_crc32 and, if asked for, the ids (binary, 32 bits each)."""
    schema = "file string, offset long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches):
        fs, _ = open_fs(folder)
        files = {}
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "size"))))
            at = 0
            while at < len(rows):                      # neighbours in a file come in one read
                file, lo, size = rows[at]
                end, upto = lo + size, at + 1
                while upto < len(rows) and rows[upto][:2] == (file, end) and end - lo < READ_BYTES:
                    end += rows[upto][2]
                    upto += 1
                if file not in files:
                    files = {file: fs.open_input_file(file)}
                data = files[file].read_at(end - lo, lo)
                yield _checked(file, [(o, data[o - lo:o - lo + s]) for _, o, s in rows[at:upto]], keep_ids)
                at = upto

    return index.select("file", "offset", "size").mapInArrow(run, schema)


def _checked(file: str, frames: list[tuple[int, bytes]], keep_ids: bool) -> pa.RecordBatch:
    heads, payloads = [f[:8] for _, f in frames], [f[12:-4] for _, f in frames]
    for (offset, f), p, hc, pc in zip(frames, payloads, crc32c_many(heads), crc32c_many(payloads)):
        if struct.unpack("<Q", f[:8])[0] != len(p) or struct.unpack("<I", f[8:12])[0] != masked(hc) or struct.unpack("<I", f[-4:])[0] != masked(pc):
            raise ValueError(f"damaged record in {file} at {offset}")
    out = []
    for (offset, _), (key, ids) in zip(frames, parse(payloads)):
        raw = ids.astype("<u4").tobytes()
        out.append((file, offset, key, len(ids), zlib.crc32(raw), raw))
    cols = list(zip(*out))[: 6 if keep_ids else 5]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      names=["file", "offset", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])


def starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with ``start``: the ids of all documents before, in file and offset order. One
    total per file is summed on the driver (a file is a whole shuffle partition), the rest in the file."""
    from pyspark.sql import Window
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("__before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    place = index.select("file", "offset", F.coalesce(inside, F.lit(0)).alias("__inside")).join(F.broadcast(before), "file")
    return (records.join(place, ["file", "offset"])
            .withColumn("start", F.col("__before") + F.col("__inside")).drop("__before", "__inside"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs``, read every record back and number the ids: doc_id, start, n_tokens, ids_crc32."""
    folder = new_dir(docs.sparkSession, "records")
    index = write_records(docs, folder, tokenizer=tokenizer)
    return starts(read_records(index, folder, keep_ids=False), index).select("doc_id", "start", "n_tokens", "ids_crc32")
