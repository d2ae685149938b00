"""Exact substring dedup: equal strings around content anchors, found by hashes (no suffix or LPF array).

Asked for: every place whose next ``length`` bytes also start somewhere else. A suffix array of
the whole corpus would be eight times its size, so suffixes are first thinned by content:

1. Anchors. Every ``length``-byte string is owned by one anchor inside it: the place of the
   smallest hash among its ``GRAM``-byte grams (rightmost of equals). Equal strings have equal
   owners, so only suffixes near anchors with equal grams need comparing. An anchor is one row:
   hash of its gram, hash of its context (all bytes of the strings it owns), place. Of equal
   contexts within a block of the scan only the first is sent on; the others are settled there
   (a line repeated a million times is one row and one range).
2. Rows are shuffled by gram and streamed in (gram, context) order. Contexts that occur twice
   or more settle all their strings at once. Grams with one context are done; where a gram has
   several, one copy of each context goes on.
3. Contexts that go on are cut out of the texts and shuffled by gram. Of each group, the
   strings of ``length`` bytes whose 64-bit hash occurs twice are grouped by it and their bytes
   compared (ordered by bytes only after a collision); the smallest and largest place of a
   group say which strings have an earlier and a later match.
   A gram with more than ``GROUP_CONTEXTS`` contexts isn't gathered: its strings go to a second
   shuffle as (128-bit hash, place) rows and are streamed.
4. Each document unites what was found for it and drops the covered bytes.

Places before (``earlier``) and after (``later``) are told apart by scan order: dropping places with
an earlier match keeps the first copy, dropping both kinds removes every copy. Matches
never cross documents. No group is held whole beyond the bound above; texts are never shuffled,
what is found comes back to them by block of the scan.

Nulls are empty; repeated rows are documents of their own (all but the first have earlier
matches); an empty table gives no rows. The input is read once and stored in numbered blocks, which
all three passes read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Blocks, Kept, stored, text_bytes

LENGTH = 400                   # fixed value
GRAM = 200
BLOCK_BYTES = 32 << 20
SEGMENT = 1 << 19              # starts whose hashes are held at once
GROUP_CONTEXTS = 8192          # about 100 MB of a task while they are compared
BATCH_CONTEXTS = 1000          # contexts of small groups ordered together

_BASE = np.uint64(0x9E3779B97F4A7C15)
EARLIER, LATER, ASK, NAME = range(4)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def rise(b):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return rise(_BASE), rise(np.uint64(pow(int(_BASE), -1, 1 << 64)))


_UP, _DOWN = _powers(SEGMENT + 4096)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``width`` consecutive bytes."""
    s = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:len(data)], dtype=np.uint64)])
    h = (s[width:] - s[:-width]) * _DOWN[:len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): anchors of a text and the starts of the strings each owns."""
    found = []
    starts, width = len(text) - length + 1, length - gram + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(starts, 0), SEGMENT):
        n = min(SEGMENT, starts - at)
        h = rolling(data[at:at + n + length - 1], gram)
        low = np.uint64((1 << 20) - 1)
        m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))       # smallest hash, rightmost first
        span = 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
        place = (low - (m & low)).astype(np.int64)
        new = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate([[0], new])
        found.append((place[first] + at, first + at, np.concatenate([new, [n]]) - 1 + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


ANCHORS = "gram long, context long, block long, place long, reach int"
# place: document in block << 32 | first owned start; reach: last - first owned start, with bit 16 set if
# the context occurs again in the block. A negative reach, -1 - (last - first), is a settled range of starts.
AGAIN = 1 << 16


def _combine(gram: np.ndarray, context: np.ndarray, place: np.ndarray, last: np.ndarray):
    """Of equal (gram, context) in scan order: which come first, whether others follow, and the ranges
    (place, last - first) that the others own, adjacent ones joined."""
    order = np.lexsort((context, gram))
    new = np.concatenate([[True], (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1])])
    first = np.zeros(len(gram), bool)
    first[order] = new                                   # a stable sort: the first in scan order leads
    again = np.zeros(len(gram), bool)
    again[order] = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
    at = np.flatnonzero(~first)
    if not len(at):
        return first, again, at, at
    lo, hi = place[at], place[at] + last[at]
    room = (1 << 16) - 512                               # a joined range still fits 16 bits
    head = np.concatenate([[True], lo[1:] != hi[:-1] + 1])
    run = np.flatnonzero(head)[np.cumsum(head) - 1]
    head |= np.concatenate([[False], (lo[1:] - lo[run][1:]) // room != (lo[:-1] - lo[run][:-1]) // room])
    start = np.flatnonzero(head)
    return first, again, lo[start], hi[np.append(start[1:], len(at)) - 1] - lo[start]




def _anchor_rows(src: Blocks, length: int, gram: int) -> DataFrame:
    digest = xxhash.xxh64_intdigest

    def run(blocks):
        for number, cols in blocks:
            grams, contexts, places, reaches = [], [], [], []
            for doc, text in enumerate(cols["text"]):
                p, lo, hi = anchors(text, length, gram)
                for a, b, c in zip(p.tolist(), lo.tolist(), hi.tolist()):
                    grams.append(digest(text[a:a + gram], 1))
                    contexts.append(digest(text[b:c + length], a - b))
                places.append(lo | doc << 32)
                reaches.append(hi - lo)
            if grams:
                keys, classes, place, last = _signed(grams), _signed(contexts), np.concatenate(places), np.concatenate(reaches)
                first, again, lo, more = _combine(keys, classes, place, last)
                spread = (lo * 0x9E3779B1 + number) ^ lo >> 7            # settled ranges go anywhere, evenly
                cols = [np.concatenate(x) for x in ((keys[first], spread), (classes[first], spread), (place[first], lo),
                                                    (last[first] | np.where(again[first], AGAIN, 0), -1 - more))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(len(cols[0]), number)), pa.array(cols[2]),
                     pa.array(cols[3].astype(np.int32))], names=["gram", "context", "block", "place", "reach"])

    return src.map(run, ANCHORS)


FOUND = "block long, place long, reach int, kind int, gram long"


def _settle(batches):
    """Stream (gram, context, place) order. Carried over: the first row of the open gram and of the open
    context, each with what was said of it already."""
    names = ["gram", "context", "block", "place", "reach"]
    carry, told, asked = [np.zeros(0, np.int64)] * 5, np.zeros(0, bool), np.zeros(0, bool)
    for b in batches:
        rows = [b.column(n).to_numpy().astype(np.int64) for n in names]
        done = np.flatnonzero(rows[4] < 0)
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array(rows[2][done]), pa.array(rows[3][done]), pa.array((-1 - rows[4][done]).astype(np.int32)),
                                              pa.array(np.full(len(done), EARLIER, np.int32)), pa.array(rows[0][done])],
                                             names=["block", "place", "reach", "kind", "gram"])
            rows = [np.delete(c, done) for c in rows]
        if not len(rows[0]):
            continue
        cols = [np.concatenate([c, r]) for c, r in zip(carry, rows)]
        told, asked = (np.concatenate([x, np.zeros(len(rows[0]), bool)]) for x in (told, asked))
        gram, context = cols[:2]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_class = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        of_class, of_gram = np.cumsum(new_class) - 1, np.cumsum(new_gram) - 1
        many = (np.bincount(of_class)[of_class] > 1) | ((cols[4] & AGAIN) > 0)
        several = np.bincount(of_gram[new_class])[of_gram] > 1
        says = [(many & ~new_class, EARLIER), (many & new_class & ~told, LATER), (new_class & several & ~asked, ASK)]
        out = [[np.concatenate([c[on] for on, _ in says]) for c in cols], np.concatenate([np.full(on.sum(), k, np.int32) for on, k in says])]
        if len(out[1]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0][2]), pa.array(out[0][3]), pa.array((out[0][4] & 0xFFFF).astype(np.int32)), pa.array(out[1]), pa.array(out[0][0])],
                                             names=["block", "place", "reach", "kind", "gram"])
        last = np.unique([np.flatnonzero(new_gram)[-1], np.flatnonzero(new_class)[-1]])
        carry, told, asked = [c[last] for c in cols], (told | many)[last], (asked | several)[last]


CUT = "gram long, block long, place long, reach int, bytes binary"


def _cut_contexts(src: Blocks, settled: Kept, length: int) -> DataFrame:
    def run(blocks):
        for number, cols, t in blocks:
            if t is None:
                continue
            t = t.filter(pa.compute.equal(t["kind"], ASK))
            for at in range(0, t.num_rows, 5000):
                part = t.slice(at, 5000)
                cut = [cols["text"][p >> 32][p & 0xFFFFFFFF:(p & 0xFFFFFFFF) + (r & 0xFFFF) + length]
                       for p, r in zip(part["place"].to_pylist(), part["reach"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in ("gram",)), pa.array(np.full(len(cut), number)),
                                                  *(part[c].combine_chunks() for c in ("place", "reach")), pa.array(cut, pa.binary())],
                                                 names=["gram", "block", "place", "reach", "bytes"])

    return src.map(run, CUT, (settled,))


def previous_factors(suffix_order: np.ndarray, heads: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix has a match of full length at an earlier and at a later position.
    ``heads[k]``: the k-th suffix in order has other first bytes than the one before. Within such a
    run every common prefix is full, so the previous or next smaller position of a suffix exists
    there exactly if it is not the run's smallest position; likewise for larger ones."""
    run = np.cumsum(heads) - 1
    pos = position[suffix_order]
    first = np.flatnonzero(heads)
    smallest, largest = np.minimum.reduceat(pos, first), np.maximum.reduceat(pos, first)
    earlier, later = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    earlier[suffix_order] = pos > smallest[run]
    later[suffix_order] = pos < largest[run]
    return earlier, later


def compare(contexts: list[bytes], order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start in it, earlier, later) of every owned string that occurs twice or more;
    ``order`` ranks the contexts' places, each place's starts follow each other."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    n = sizes - length + 1
    which = np.repeat(np.arange(len(contexts)), n)
    start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + start
    name = np.concatenate([rolling(data[b:b + s], length) for b, s in zip(begin, sizes)])
    _, of, times = np.unique(name, return_inverse=True, return_counts=True)
    on = np.flatnonzero(times[of] > 1)
    which, start, at = which[on], start[on], at[on]
    if not len(on):
        return which, start, np.zeros(0, bool), np.zeros(0, bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    by_name = np.argsort(of[on], kind="stable")
    heads = np.concatenate([[True], of[on][by_name][1:] != of[on][by_name][:-1]])
    here = at[by_name]
    same = np.concatenate([[False], *((windows[here[a + 1:a + 16385]] == windows[here[a:a + 16384][:len(here) - a - 1]]).all(axis=1)
                                      for a in range(0, len(here) - 1, 16384))])
    if (same != ~heads).any():                                    # equal hashes, other bytes: order by the bytes themselves
        rows = np.ascontiguousarray(windows[at]).view(f"V{length}").ravel()
        by_name = np.argsort(rows, kind="stable")
        heads = np.concatenate([[True], rows[by_name][1:] != rows[by_name][:-1]])
    earlier, later = previous_factors(by_name, heads, order[which] << 32 | start)
    return which, start, earlier, later


def _resolve(length: int):
    names = ["gram", "block", "place", "reach", "bytes"]

    def ranges(rows, which, start, on, kind):
        which, start = which[on], start[on]
        if not len(which):
            return None
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)]))
        end = np.append(new[1:], len(which)) - 1
        c = which[new]
        return pa.RecordBatch.from_arrays([pa.array(rows[1][c]), pa.array(rows[2][c] + start[new]), pa.array((start[end] - start[new]).astype(np.int32)),
                                           pa.array(np.full(len(c), kind, np.int32)), pa.array(np.zeros(len(c), np.int64)), pa.array(np.zeros(len(c), np.int64))],
                                          names=["block", "place", "reach", "kind", "name", "name2"])

    def small(rows):
        contexts = rows[4]
        order = np.empty(len(contexts), np.int64)
        order[np.lexsort((rows[2], rows[1]))] = np.arange(len(contexts))
        which, start, earlier, later = compare(contexts, order, length)
        for on, kind in ((earlier, EARLIER), (later, LATER)):
            out = ranges(rows, which, start, on, kind)
            if out is not None:
                yield out

    def large(rows):
        """Strings of a gram with very many contexts, by name."""
        for block, place, c in zip(rows[1].tolist(), rows[2].tolist(), rows[4]):
            n = len(c) - length + 1
            d = [xxhash.xxh3_128_intdigest(c[i:i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(place + np.arange(n)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, NAME, np.int32)),
                                              pa.array(_signed([x >> 64 for x in d])), pa.array(_signed([x & (1 << 64) - 1 for x in d]))],
                                             names=["block", "place", "reach", "kind", "name", "name2"])

    def run(batches):
        """Rows come sorted by gram. Whole small groups are compared together; a group that passes the
        bound is sent on by name, row after row."""
        held = [np.zeros(0, np.int64)] * 4 + [[]]
        flowing = None
        for b in batches:
            cols = [b.column(n).to_numpy().astype(np.int64) for n in names[:4]] + [b.column("bytes").to_pylist()]
            held = [np.concatenate([h, c]) for h, c in zip(held[:4], cols[:4])] + [held[4] + cols[4]]
            while len(held[4]):
                gram = held[0]
                if flowing is not None:                            # the open group is past the bound
                    k = int(np.searchsorted(gram != flowing, True)) if (gram != flowing).any() else len(gram)
                    yield from large([h[:k] for h in held])
                    held = [h[k:] for h in held]
                    if k < len(gram):
                        flowing = None
                        continue
                    break
                first = int(np.flatnonzero(gram == gram[-1])[0])    # the last group may go on
                if first >= BATCH_CONTEXTS:
                    for part in _bounded(gram[:first]):
                        rows = [h[part] for h in held[:4]] + [held[4][part]]
                        yield from large(rows) if part.stop - part.start > GROUP_CONTEXTS and (rows[0] == rows[0][0]).all() else small(rows)
                    held = [h[first:] for h in held]
                    continue
                if len(gram) - first > GROUP_CONTEXTS:
                    if first:
                        yield from small([h[:first] for h in held])
                        held = [h[first:] for h in held]
                    flowing = int(gram[-1])
                    continue
                break
        for part in _bounded(held[0]):
            rows = [h[part] for h in held[:4]] + [held[4][part]]
            if flowing is not None and int(rows[0][0]) == flowing or part.stop - part.start > GROUP_CONTEXTS and (rows[0] == rows[0][0]).all():
                yield from large(rows)
            else:
                yield from small(rows)

    return run


def _bounded(gram: np.ndarray):
    """Slices of whole groups, each of about BATCH_CONTEXTS rows or one larger group."""
    if not len(gram):
        return
    cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
    lo = 0
    for a, b in zip(cuts, cuts[1:]):
        if a > lo and b - lo > BATCH_CONTEXTS:
            yield slice(lo, a)
            lo = a
    yield slice(lo, len(gram))


def _named(batches):
    """Stream (name, position) order; only the first row of the open name is carried over."""
    cols = ["name", "name2", "block", "place"]
    carry, told = [np.zeros(0, np.int64)] * 4, np.zeros(0, bool)
    for b in batches:
        if not b.num_rows:
            continue
        x = [np.concatenate([c, b.column(n).to_numpy()]) for c, n in zip(carry, cols)]
        told = np.concatenate([told, np.zeros(b.num_rows, bool)])
        new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
        of = np.cumsum(new) - 1
        many = np.bincount(of)[of] > 1
        says = [(many & ~new, EARLIER), (many & new & ~told, LATER)]
        block, place = (np.concatenate([x[i][on] for on, _ in says]) for i in (2, 3))
        kind = np.concatenate([np.full(on.sum(), k, np.int32) for on, k in says])
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(place), pa.array(np.zeros(len(kind), np.int32)), pa.array(kind)], names=["block", "place", "reach", "kind"])
        last = np.flatnonzero(new)[-1:]
        carry, told = [c[last] for c in x], (told | many)[last]


def matches(src: Blocks, length: int = LENGTH, gram: int = GRAM) -> tuple[Kept, Kept]:
    """Kept by block: the found ranges of starts: place (document in block << 32 | start),
    reach (its low 16 bits: further starts), kind (EARLIER, LATER; other kinds are not matches)."""
    settled = Kept(_anchor_rows(src, length, gram).repartition("gram")
                            .sortWithinPartitions("gram", "context", "block", "place").mapInArrow(_settle, FOUND), "suffix-settled")
    compared = stored(_cut_contexts(src, settled, length).repartition("gram").sortWithinPartitions("gram")
                      .mapInArrow(_resolve(length), "block long, place long, reach int, kind int, name long, name2 long"), "suffix-compared")
    plain = compared.where(F.col("kind") != NAME).select("block", "place", "reach", "kind")
    named = (compared.where(F.col("kind") == NAME).select("name", "name2", "block", "place")
             .repartition("name", "name2").sortWithinPartitions("name", "name2", "block", "place")
             .mapInArrow(_named, "block long, place long, reach int, kind int"))
    return settled, Kept(plain.union(named), "suffix-found")


def covered(n_bytes: int, starts: np.ndarray, reach: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered runs (begin, end) of a text whose strings start..start + reach match."""
    cover = np.zeros(n_bytes + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + reach + length, -1)
    on = np.concatenate([[False], np.cumsum(cover)[:n_bytes] > 0, [False]])
    return np.stack([np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:])], axis=1)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
           keep_first: bool = True, keep_bytes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, span_starts, span_ends, kept_sha256 and, if asked for, the kept
    bytes. ``keep_first``: drop only strings that start earlier somewhere; else every repeated one."""
    src = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("text"))
    blocks = Blocks(src, "suffix-blocks", BLOCK_BYTES)
    found = matches(blocks, length, gram)
    kinds = (EARLIER,) if keep_first else (EARLIER, LATER)
    id_type = src.limit(0).toArrow().schema.field("__id").type
    schema = (f"__id {src.schema['__id'].dataType.simpleString()}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string"
              + (", kept binary" if keep_bytes else ""))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [id_type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]

    def run(dealt):
        for _, cols, *tables in dealt:
            tables = [t.select(["place", "reach", "kind"]) for t in tables if t is not None]
            place, reach, kind = (np.concatenate([t[c].to_numpy() for t in tables] or [np.zeros(0, np.int64)]).astype(np.int64) for c in ("place", "reach", "kind"))
            on = np.isin(kind, kinds)
            place, reach = place[on], reach[on] & 0xFFFF
            order = np.argsort(place, kind="stable")
            place, reach = place[order], reach[order]
            cuts = np.searchsorted(place, np.arange(len(cols["text"]) + 1) << 32)
            rows, held = [], 0
            for doc, (key, text) in enumerate(zip(cols["__id"], cols["text"])):
                a, b = cuts[doc], cuts[doc + 1]
                spans = covered(len(text), place[a:b] & 0xFFFFFFFF, reach[a:b], length) if b > a else np.zeros((0, 2), np.int64)
                kept = text
                if len(spans):
                    edges = [0, *spans.ravel().tolist(), len(text)]
                    kept = b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2]))
                rows.append((key, len(text), len(text) - len(kept), spans[:, 0], spans[:, 1], hashlib.sha256(kept).hexdigest(), kept)[:len(names)])
                held += len(kept) if keep_bytes else 0
                if len(rows) >= 5000 or held > BLOCK_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return blocks.map(run, schema, found).withColumnRenamed("__id", id_col)
