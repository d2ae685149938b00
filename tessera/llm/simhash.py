"""SimHash near-dedup with a byte-position inverted index and count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints at most
``max_bits`` bits apart differ in at most ``max_bits`` bytes, so they share at least
``8 - max_bits`` positional bytes: the guaranteed minimum of matches. A posting list per
single (position, byte) would hold N/256 fingerprints and the tally would meet N^2/32
pairs, so a list here is keyed by ``8 - max_bits`` positions and their bytes together
(28 lists a fingerprint for two bits). Members of a list reach the minimum; their other
shared bytes are tallied, and pairs are verified by bit distance. Members of one list differ
only in the ``max_bits`` free bytes, so a list has at most ``256 ** max_bits`` distinct
fingerprints however many documents copy each other; long lists are probed by the possible
differences instead of by pairs, which keeps the work linear in the list.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows
are documents of their own. A null id takes part, but is never a component id unless no
other id is reachable.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import emit, stored, text_bytes

SEED = 42            # fixed value
SHINGLE_WORDS = 3    # fixed value
MAX_BITS = 2         # fixed value
CHUNK = 1 << 15      # shingles whose bits are tallied at once
SHORT_LIST = 32      # longer posting lists are probed instead of paired


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased words: XXH64 of each shingle, majority of each bit."""
    words = text.lower().split()          # bytes: only A-Z change; splits at 0x20, 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle_words - 1:].tolist() if len(words) >= shingle_words else [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(last)).view(">u8")[0])


def fingerprints(docs: DataFrame, key_cols: list[str], text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``key_cols`` and the fingerprint (as a signed long) of every row."""
    src = docs.select(*key_cols, text_bytes(text_col).alias("__text"))
    out = src.drop("__text").withColumn("fp", F.lit(0).cast("long"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key_cols), pa.array(fps.view(np.int64))],
                                             names=[*key_cols, "fp"])

    return src.mapInArrow(run, out.schema)


def _position_masks(max_bits: int) -> list[int]:
    """A 64-bit mask for each choice of 8 - max_bits byte positions."""
    return [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), 8 - max_bits)]


def _differences(mask: int, max_bits: int) -> np.ndarray:
    """All bit patterns of 1..max_bits bits outside ``mask``."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for n in range(1, max_bits + 1) for c in combinations(free, n)], np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n items by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _list_links(which: np.ndarray, fp: np.ndarray, masks: np.ndarray, max_bits: int):
    """Links inside complete posting lists, rows sorted by list and fingerprint."""
    part = fp & masks[which]
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.append(new, len(fp)))
    lists = np.repeat(np.arange(len(new)), size)
    left, right = [], []
    short = size[lists] <= SHORT_LIST
    for step in range(1, int(min(size.max(), SHORT_LIST))):
        i = np.flatnonzero((lists[step:] == lists[:-step]) & short[:-step])
        x = fp[i] ^ fp[i + step]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)      # tally of positional bytes
        i = i[(shared >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        left.append(i)
        right.append(i + step)
    for k in np.flatnonzero(size > SHORT_LIST):
        lo, hi = new[k], new[k] + size[k]
        own = fp[lo:hi]
        for d in _differences(int(masks[which[lo]]), max_bits):
            other = own ^ d
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            i = np.flatnonzero((own[at] == other) & (own < other))
            left.append(lo + i)
            right.append(lo + at[i])
    a, b = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    root = _roots(len(fp), a, b)
    i = np.flatnonzero(root != np.arange(len(fp)))
    return fp[i], fp[root[i]]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``max_bits``:
    within each posting list every member points to the first it is connected with."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits is 1 to 3")
    masks = _position_masks(max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = (fps.select("fp").distinct()
                .select("fp", F.explode(F.array(*[
                    F.struct(F.lit(i).cast("byte").alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
                    for i, m in enumerate(signed)])).alias("k"))
                .select("k.which", "k.bytes", "fp")
                .repartition("which", "bytes").sortWithinPartitions("which", "bytes", "fp"))
    all_masks = np.array(masks, np.uint64)

    def run(batches):
        def pieces():
            which, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in batches:
                which = np.concatenate([which, b.column("which").to_numpy().astype(np.int64)])
                fp = np.concatenate([fp, b.column("fp").to_numpy()])
                last = (which == which[-1]) & ((fp.view(np.uint64) & all_masks[which]) == (fp[-1:].view(np.uint64) & all_masks[which[-1]]))
                cut = int(np.flatnonzero(last)[0])       # the last list may go on in the next batch
                if cut:
                    yield which[:cut], fp[:cut]
                which, fp = which[cut:], fp[cut:]
            if len(fp):
                yield which, fp

        def found():
            for which, fp in pieces():
                order = np.lexsort((fp.view(np.uint64), fp.view(np.uint64) & all_masks[which], which))
                a, b = _list_links(which[order], fp[order].view(np.uint64), all_masks, max_bits)
                yield a.view(np.int64), b.view(np.int64)

        yield from emit(found(), ["a", "b"], [pa.int64()] * 2)

    return postings.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large-star
    and small-star rounds over the edge table. Roots themselves have no row. The edges are
    checkpointed each round; ``max_rounds`` only guards against an endless loop (an error)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))   # large star
             .where("u <> v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                       F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
             .select("e.*").where("u <> v").distinct().checkpoint())                                    # small star
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (),
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, ``extra`` columns, fp, group (the component's smallest
    fingerprint) and component_id (its smallest id)."""
    rows = stored(fingerprints(docs, [id_col, *extra], text_col, shingle_words), "simhash-rows")
    per_fp = rows.groupBy("fp").agg(F.min(id_col).alias("__min"))
    roots = components(links(rows, max_bits))
    per_fp = stored(per_fp.join(roots, per_fp.fp == roots.node, "left")
                    .select("fp", "__min", F.coalesce("root", "fp").alias("group")), "simhash-groups")
    smallest = per_fp.groupBy("group").agg(F.min("__min").alias("component_id"))
    named = per_fp.join(smallest, "group").select("fp", "group", "component_id")
    return rows.join(named, "fp").select(id_col, *extra, "fp", "group", "component_id")
