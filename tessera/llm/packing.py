"""Sequence packing by minimum bin slack.

Documents become token pieces: whole windows of ``window`` ids first, each a sequence of its
own, then one remaining length. Remaining lengths are dealt into groups of about
``GROUP_PIECES`` by a hash of a stored piece number (so no document or source can make a group
large), and each group is packed by itself: a window takes the longest length left, and a
bitset subset-sum over the multiset of the other lengths finds the fill closest to capacity,
whose counts are backtracked from the stored steps. A chosen multiset is repeated while the
counts allow it. Slack remains only where a group runs out of lengths.

Null text is an empty document (its end id only); repeated rows are packed as documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.tokens import encoder

WINDOW = 1024             # fixed value
END_ID = 0                # fixed value
GROUP_PIECES = 16_384


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is the largest not above ``room``."""
    keep = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:                                    # 1, 2, 4, ... copies, then the rest
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= reach << length * many & keep
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    goal, taken = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * many
            taken[length] = taken.get(length, 0) + many
    return taken


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each length."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        where.setdefault(x, []).append(i)
    counts = {x: len(v) for x, v in where.items()}
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    sequence = 0
    while counts:
        first = max(counts)
        counts[first] -= 1
        taken = best_fill({x: c for x, c in counts.items() if c}, window - first)
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        for _ in range(min(counts[x] // n for x, n in taken.items())):
            offset = 0
            for x, n in taken.items():
                for _ in range(n):
                    out[where[x].pop()] = (sequence, offset)
                    offset += x
            for x, n in taken.items():
                counts[x] -= n
            sequence += 1
        counts = {x: c for x, c in counts.items() if c}
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
           tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The stored pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, piece
    (a unique number) and, if asked for, the ids (binary, 32 bits each)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(tokenizer).encode_many
        for b in batches:
            which, cols = [], ([], [], [], [], [])
            for i, ids in enumerate(encode(b.column("text").to_pylist())):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at:at + 4 * window]
                    which.append(i)
                    for c, x in zip(cols, (at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if keep_ids else None)):
                        c.append(x)
            arrays = [b.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return stored(src.mapInArrow(run, schema).withColumn("piece", F.monotonically_increasing_id()), "pieces")


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (without their number) with sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    out = dealt.drop("piece", "grp").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        placed = np.array(pack_lengths(table["length"].to_pylist(), window), np.int64).reshape(-1, 2)
        base = int(table["grp"][0].as_py()) << 32      # a group holds far fewer than 2^32 sequences
        return (table.drop_columns(["piece", "grp"])
                .append_column("sequence_id", pa.array(placed[:, 0] + base)).append_column("offset", pa.array(placed[:, 1])))

    return dealt.groupBy("grp").applyInArrow(run, out.schema)
