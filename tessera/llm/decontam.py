"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments, one per Arrow batch, stored as a Parquet table in the
shared folder: for each benchmark word the ascending positions of its tokens in the segment,
with one gap position between documents. Document frequencies of the words are summed over
all segments. Each test window (10 consecutive item words, or the whole of a shorter item)
then starts from the posting list of its rarest word, adjusted by that word's offset, and is
intersected with the lists of its other words in order of rarity; what is left are exact
phrase matches. A window is near a document if, laid somewhere over it, at least ``SHARE`` of its
words (rounded up) stand in the document within ``slop`` words of their places. A window of L words
that needs n has some matched word among any L - n + 1 of its words, so places are tried from that
many of its rarest words only; words that no document holds are missed ones and need no trial.

The benchmark is the stated query set. It is taken in blocks of at most ``BLOCK_BYTES`` of
text; each block is broadcast and run against all documents. With more than one block the rows are
numbered once and stored, and blocks are united by that number, never by id.

Null texts have no words, null items match nothing; repeated document rows are judged one by
one, repeated items count once per item_id. An empty table on either side gives no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_bytes

WINDOW = 10                 # fixed value
SLOP = 5                    # words a proximity match may be off
SHARE = (4, 5)              # of a window's words that a proximity match holds
NEAR_ROWS = 1 << 18         # (window, place) candidates of a proximity match tried at once
BLOCK_BYTES = 32 << 20      # benchmark text broadcast at once
SEGMENT_BYTES = 64 << 20    # document text of one segment, unless a single text is longer

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII code points."""
    return text.translate(_MAP).split()


class Windows:
    """Test windows of one block of items, over a dense word numbering."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.size = size
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({n for n, _ in items})
        place = {n: i for i, n in enumerate(self.names)}
        rows = []
        for name, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            rows += [(place[name], ids[i:i + size]) for i in range(max(1, len(ids) - size + 1)) if ids]
        self.item = np.array([r[0] for r in rows], np.int64)
        self.length = np.array([len(r[1]) for r in rows], np.int64)
        self.word = np.full((len(rows), size), -1, np.int64)
        for i, (_, ids) in enumerate(rows):
            self.word[i, :len(ids)] = ids

    def rank(self, df: np.ndarray) -> None:
        """Order each window's words by document frequency; mark those whose places are tried for
        proximity: of a window that may lack m words, the rarest m + 1, without those no document holds."""
        cost = np.where(self.word >= 0, np.append(df, 0)[self.word], np.iinfo(np.int64).max)
        self.offset = np.argsort(cost, axis=1, kind="stable")
        self.by_rarity = np.take_along_axis(self.word, self.offset, axis=1)
        self.may_lack = self.length - -(-self.length * SHARE[0] // SHARE[1])
        self.tried = (np.arange(self.size) <= self.may_lack[:, None]) & (np.append(df, 0)[self.by_rarity] > 0)


SEGMENT = "numbers array<long>, rows array<long>, lengths array<long>, terms array<int>, counts array<int>, places binary"


def index(src: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """The stored segments of all documents (number, row, text) for the words of ``vocab``."""
    sent = src.sparkSession.sparkContext.broadcast(vocab)

    def segment(numbers, rows, ids):
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.full(int(lengths.sum()) + len(ids), -1, np.int32)
        at = 0
        for x in ids:
            flat[at:at + len(x)] = x
            at += len(x) + 1
        places = np.flatnonzero(flat >= 0).astype(np.int32)
        places = places[np.argsort(flat[places], kind="stable")]
        terms, counts = np.unique(flat[places], return_counts=True)
        cols = [numbers, rows, lengths, terms, counts.astype(np.int32)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array([c], pa.list_(k)) for c, k in zip(cols, kinds)] + [pa.array([places.tobytes()], pa.binary())],
            names=["numbers", "rows", "lengths", "terms", "counts", "places"])

    def run(batches):
        get = sent.value.get
        for b in batches:
            numbers, rows, ids, held = [], [], [], 0
            for number, row, text in zip(*(b.column(c).to_pylist() for c in ("number", "row", "text"))):
                if rows and held + len(text) > SEGMENT_BYTES:
                    yield segment(numbers, rows, ids)
                    numbers, rows, ids, held = [], [], [], 0
                numbers.append(number)
                rows.append(row)
                ids.append(np.array([get(w, -1) for w in words(text)], np.int32))
                held += len(text)
            if rows:
                yield segment(numbers, rows, ids)

    return stored(src.mapInArrow(run, SEGMENT), "postings")


def document_frequency(segments: DataFrame, size: int) -> np.ndarray:
    """Tokens of each word over all segments (one row per benchmark word)."""
    df = np.zeros(size, np.int64)
    pairs = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    for r in pairs.collect():
        df[r.terms] = r.n
    return df


def intersect(w: Windows, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches (window, start) in one segment: offset-adjusted list of the rarest word,
    cut down word by word in order of rarity."""
    have = np.zeros(len(w.vocab) + 1, bool)
    have[terms] = True
    have[-1] = True                                     # padding of windows of short items
    live = np.flatnonzero(have[w.word].all(axis=1))
    slot = np.full(len(w.vocab), -1)
    slot[terms] = np.arange(len(terms))
    first = np.cumsum(counts) - counts
    holds = np.full(total, -1, np.int32)
    holds[places] = np.repeat(terms, counts)
    s = slot[w.by_rarity[live, 0]]
    n = counts[s]
    win = np.repeat(live, n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
    start = places[at].astype(np.int64) - w.offset[win, 0]
    ok = (start >= 0) & (start + w.length[win] <= total)
    win, start = win[ok], start[ok]
    for k in range(1, w.size):
        want = w.by_rarity[win, k]
        where = np.minimum(start + w.offset[win, k], total - 1)
        ok = (want < 0) | (holds[where] == want)
        win, start = win[ok], start[ok]
    return win, start


def close_by(w: Windows, terms, counts, places, lengths, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximity matches (item, document in the segment), without repetition."""
    begin = np.cumsum(lengths + 1) - lengths - 1
    total = int(lengths.sum()) + len(lengths)
    slot = np.full(len(w.vocab) + 1, -1)
    slot[terms] = np.arange(len(terms))
    first = np.cumsum(counts) - counts
    order = np.repeat(np.arange(len(terms)), counts) * total + places       # ascending: by word, then place
    there = slot[w.by_rarity] >= 0
    able = (~there & (w.by_rarity >= 0)).sum(axis=1) <= w.may_lack
    win, rank = np.nonzero(w.tried & there & able[:, None])
    ends = np.cumsum(counts[slot[w.by_rarity[win, rank]]])
    items, docs = [], []

    def within(word, lo, hi):
        """Whether ``word`` stands at a place of lo..hi."""
        s = slot[word]
        at = np.searchsorted(order, s * total + lo)
        return (s >= 0) & (lo <= hi) & (order[np.minimum(at, len(order) - 1)] <= s * total + hi) & (at < len(order))

    for lo in range(0, int(ends[-1]) if len(ends) else 0, NEAR_ROWS):
        k = np.arange(lo, min(lo + NEAR_ROWS, int(ends[-1])))
        of = np.searchsorted(ends, k, "right")
        c, anchor = win[of], rank[of]
        s = slot[w.by_rarity[c, anchor]]
        at = places[first[s] + k - (ends[of] - counts[s])].astype(np.int64)
        doc = np.searchsorted(begin, at, "right") - 1
        start = at - w.offset[c, anchor]                               # where the window would begin
        lack = np.zeros(len(c), np.int64)
        for j in range(w.size):                                        # any laying has its words this near
            word, x = w.by_rarity[c, j], start + w.offset[c, j]
            lack += (word >= 0) & ~within(word, np.maximum(x - 2 * slop, begin[doc]), np.minimum(x + 2 * slop, begin[doc] + lengths[doc] - 1))
            on = lack <= w.may_lack[c]
            c, start, doc, lack = c[on], start[on], doc[on], lack[on]
        for d in range(-slop, slop + 1):
            lack = np.zeros(len(c), np.int64)
            for j in range(w.size):
                word, x = w.by_rarity[c, j], start + d + w.offset[c, j]
                lack += (word >= 0) & ~within(word, np.maximum(x - slop, begin[doc]), np.minimum(x + slop, begin[doc] + lengths[doc] - 1))
            hit = lack <= w.may_lack[c]
            items.append(w.item[c[hit]])
            docs.append(doc[hit])
            c, start, doc = c[~hit], start[~hit], doc[~hit]
    if not items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.stack([np.concatenate(items), np.concatenate(docs)]), axis=1)
    return found[0], found[1]


HITS = "number long, row long, n_words long, items array<string>, starts array<long>, ends array<long>, near_items array<string>"


def match(segments: DataFrame, w: Windows, slop: int = SLOP) -> DataFrame:
    """Per document row: its words, the items found, the hit word spans (disjoint, ascending)
    and the items found by proximity."""
    sent = segments.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        for b in batches:
            for seg in b.to_pylist():
                lengths = np.array(seg["lengths"], np.int64)
                terms, counts = np.array(seg["terms"], np.int64), np.array(seg["counts"], np.int64)
                places = np.frombuffer(seg["places"], np.int32)
                total = int(lengths.sum()) + len(lengths)
                begin = np.cumsum(lengths + 1) - lengths - 1
                win, start = intersect(w, terms, counts, places, total)
                cover = np.zeros(total + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + w.length[win], -1)
                hit = np.concatenate([[False], np.cumsum(cover)[:total] > 0, [False]])
                up, down = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
                of = lambda x: np.searchsorted(begin, x, "right") - 1
                spans, items, near = {}, {}, {}
                for d, s, e in zip(of(up).tolist(), up.tolist(), down.tolist()):
                    spans.setdefault(d, []).append((s - int(begin[d]), e - int(begin[d])))
                for d, i in set(zip(of(start).tolist(), w.item[win].tolist())):
                    items.setdefault(d, []).append(w.names[i])
                it, doc = close_by(w, terms, counts, places, lengths, slop)
                for d, i in zip(doc.tolist(), it.tolist()):
                    near.setdefault(d, []).append(w.names[i])
                k = range(len(lengths))
                cols = [seg["numbers"], seg["rows"], lengths, [sorted(items.get(d, ())) for d in k], [[s for s, _ in spans.get(d, ())] for d in k],
                        [[e for _, e in spans.get(d, ())] for d in k], [sorted(near.get(d, ())) for d in k]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 names=["number", "row", "n_words", "items", "starts", "ends", "near_items"])

    return segments.mapInArrow(run, HITS)


def find(docs: DataFrame, items: DataFrame, row_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
         window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``row`` (the long in ``row_col``), n_words, items, starts,
    ends, near_items. Rows that are equal, share ``row_col`` or have none there stay apart."""
    bench = items.select(F.col(item_col).cast("string").alias("item"), text_bytes(text_col).alias("text")).where("item is not null").distinct()
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    src = docs.select(F.col(row_col).alias("row"), text_bytes(text_col).alias("text"))
    if blocks > 1:
        src = stored(src.withColumn("number", F.monotonically_increasing_id()), "decontam-rows")
    else:
        src = src.withColumn("number", F.lit(None).cast("long"))      # nothing to unite
    parts = []
    for k in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect() if blocks > 1 else bench.collect()
        w = Windows([(r.item, words(bytes(r.text))) for r in sorted(block)], window)
        segments = index(src, w.vocab)
        w.rank(document_frequency(segments, len(w.vocab)))
        parts.append(match(segments, w, slop))
    if blocks == 1:
        return parts[0].drop("number")
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    both = both.groupBy("number").agg(F.first("row").alias("row"), F.max("n_words").alias("n_words"), flat("items").alias("items"),
                                   F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("z"), flat("near_items").alias("near_items"))
    joined = F.aggregate("z", F.array().cast("array<struct<starts:long,ends:long>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).ends >= x.starts),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).starts.alias("starts"), F.greatest(F.element_at(acc, -1).ends, x.ends).alias("ends")))))
        .otherwise(F.concat(acc, F.array(x))))
    both = both.withColumn("z", F.when(F.size("z") > 0, joined).otherwise(F.col("z")))
    return both.select("row", "n_words", "items", F.col("z.starts").alias("starts"), F.col("z.ends").alias("ends"), "near_items")
