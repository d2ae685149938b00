"""Embedding near-dedup with an epsilon grid order join.

Unit vectors with cosine ``c`` lie ``sqrt(2 - 2c)`` apart, which is the cell width (epsilon) of a grid
on the leading principal dimensions. A rotation keeps distances, and leaving dimensions out
can only shorten them, so two vectors whose cells or boxes are more than epsilon apart in these
dimensions cannot link.

1. Equal vectors of a label become one row with their number. Principal directions come from sums
   over all rows (dims^2 numbers, whatever the input).
2. Vectors are sorted by label, then by the sequence of their grid cells, then by place in the cell,
   and stored in that order. Every ``SEGMENT`` consecutive ones are a segment: one row with its
   vectors and its box. Segments are the lowest of a hierarchy of sequence intervals, ``FAN`` to one.
3. The sequence of a label is joined with itself from the top interval down: a pair of intervals
   becomes the pairs of their parts, and pairs whose boxes are more than epsilon apart are
   dropped with all below them. What is left are segment pairs that can hold links.
4. In a task, a segment pair is joined by the same recursion on halves, down to ``LEAF`` vectors, which are
   compared whole, by cosine in double precision on the vectors as given. A pair of segments
   gives one row for each vector that has links: their number, and the first vector it is
   connected with inside the pair. Links are never listed.
5. Numbers are summed; components come from star contraction over the connections.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing. Vectors of different length have no cosine and never link. Equal vectors of
a label always link, as their cosine is one. Rows of equal id are rows of their own. A null id is no component id
unless no other is reachable, and is never kept. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import emit, stored
from tessera.llm.simhash import _roots, components
from tessera.operators.ordering import in_order

THRESHOLD = 0.98      # fixed value
GRID_DIMS = 10
SEGMENT = 2048
FAN = 16
LEAF = 64
SLACK = 1e-9          # rounding of boxes and distances; only ever keeps a pair to be compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one batch as doubles, shorter ones padded with zeros (which keeps distances)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)          # squares of very large or small numbers
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(vectors: DataFrame, dims: int, grid_dims: int = GRID_DIMS) -> np.ndarray:
    """The leading principal directions of the unit vectors, as columns: from sums over all rows."""

    def run(batches):
        total, square, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), dims))
                total, square, n = total + u.sum(axis=0), square + u.T @ u, n + len(u)
        if n:
            values = np.concatenate([[n], total, square[np.triu_indices(dims)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    rows = vectors.select("vector").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    if not rows:
        return np.zeros((dims, 0))
    v = np.array([r.value for r in rows])
    square = np.zeros((dims, dims))
    square[np.triu_indices(dims)] = v[1 + dims:] / v[0]
    mean = v[1:1 + dims] / v[0]
    cov = square + np.triu(square, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :min(grid_dims, dims)]


def _apart(a, b) -> float:
    """Squared distance of two boxes, each (low, high)."""
    gap = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


class _Side:
    """A segment in memory: vectors, norms, places on the grid dimensions, boxes of its intervals."""

    def __init__(self, data: bytes, n: int, kind: str, axes: np.ndarray):
        self.x = np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)
        big = np.abs(self.x).max(axis=1, keepdims=True)
        self.x = self.x if big.max() < 1e100 and big.min() > 1e-100 else self.x / big
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.y = (self.x / self.norm[:, None]) @ axes[: self.x.shape[1]]
        self._boxes: dict = {}

    def box(self, lo: int, hi: int):
        if (lo, hi) not in self._boxes:
            self._boxes[lo, hi] = (self.y[lo:hi].min(axis=0), self.y[lo:hi].max(axis=0))
        return self._boxes[lo, hi]


def join_sequences(a: _Side, b: _Side, same: bool, threshold: float):
    """Index pairs that link, found by recursion on halves of the two sequences."""
    reach = (2 - 2 * threshold) * (1 + SLACK) + SLACK
    todo, left, right = [(0, len(a.x), 0, len(b.x))], [], []
    while todo:
        i, j, k, m = todo.pop()
        if (same and k < i) or _apart(a.box(i, j), b.box(k, m)) > reach:
            continue                               # seen from the other side, or provably distant
        if j - i <= LEAF and m - k <= LEAF:
            cos = a.x[i:j] @ b.x[k:m].T / (a.norm[i:j, None] * b.norm[None, k:m])
            p, q = np.nonzero(cos >= threshold)
            if same and i == k:
                p, q = p[p < q], q[p < q]
            left.append(p + i)
            right.append(q + k)
            continue
        # both are halved at the same places, so equal intervals of one sequence meet themselves
        cut = lambda lo, hi: [(lo, hi)] if hi - lo <= LEAF else [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        todo += [(*s, *t) for s in cut(i, j) for t in cut(k, m)]
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def segments(classes: DataFrame, axes: np.ndarray, dims: int, width: float, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """``classes`` (label, vector, ...) in grid order: the rows with their node number, and one row a segment:
    label, dims, seg (its place among the segments), first node, vectors, copies, box."""
    kind = {"float": "float32", "double": "float64"}[classes.schema["vector"].dataType.elementType.typeName()]
    k = axes.shape[1]

    def place(batches):
        for b in (b for b in batches if b.num_rows):
            y = _unit(_matrix(b.column("vector"), dims)) @ axes
            cells = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(y / width).astype(np.int64).ravel()), k).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), cells, pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), k).cast(pa.list_(pa.float64()))],
                names=[*names, "cell", "y"])

    names = classes.columns
    out = classes.withColumns({"cell": F.lit(None).cast("array<long>"), "y": F.lit(None).cast("array<double>")}).schema
    # the last keys are unique, so a crowded cell is split like any other stretch
    rows = in_order(classes.mapInArrow(place, out), ["label", "dims", "cell", "y", "vector"])
    rows = rows.withColumn("node", F.shiftleft(F.col("__part").cast("long"), 40) + F.col("__pos"))
    longest = rows.agg(F.max("__pos")).first()[0] or 0
    bits = (longest // segment).bit_length()
    rows = rows.withColumn("seg", F.shiftleft(F.col("__part").cast("long"), bits) + F.floor(F.col("__pos") / segment).cast("long"))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()
        vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        y = group["y"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, k)
        one = lambda v, t: pa.array([v], t)
        return pa.table({"label": group["label"][:1], "dims": group["dims"][:1], "seg": group["seg"][:1],
                         "nodes": one(group["node"].to_numpy().tobytes(), pa.binary()), "vectors": one(vectors.tobytes(), pa.binary()),
                         "copies": one(group["copies"].to_numpy().tobytes(), pa.binary()),
                         "low": one(y.min(axis=0), pa.list_(pa.float64())), "high": one(y.max(axis=0), pa.list_(pa.float64()))})

    label = rows.schema["label"].dataType.simpleString()
    segs = rows.select("label", "dims", "seg", "node", "copies", "vector", "y").groupBy("label", "dims", "seg").applyInArrow(
        gather, f"label {label}, dims int, seg long, nodes binary, vectors binary, copies binary, low array<double>, high array<double>")
    return rows, stored(segs, "ego-segments")


def segment_pairs(segs: DataFrame, dims: int, reach: float, fan: int = FAN) -> DataFrame:
    """(label, dims, a, b), a <= b: segments that may hold links, from the top interval down."""
    key = ["label", "dims"]
    boxes = stored(segs.select(*key, F.col("seg").alias("at"), "low", "high"), "ego-boxes")
    levels = [boxes]
    top = boxes.agg(F.max("at")).first()[0]
    side = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(dims)])
    while top is not None and top > 0:
        top //= fan
        up = levels[-1].withColumn("at", F.floor(F.col("at") / fan).cast("long"))
        levels.append(stored(up.groupBy(*key, "at").agg(side(F.min, "low").alias("low"), side(F.max, "high").alias("high")), "ego-boxes"))
    pairs = levels[-1].select(*key, F.col("at").alias("a"), F.col("at").alias("b"))
    for boxes in reversed(levels[:-1]):
        part = boxes.select(*key, F.floor(F.col("at") / fan).cast("long").alias("up"), "at", "low", "high")
        a = part.toDF(*key, "a", "new_a", "a_low", "a_high")
        b = part.toDF(*key, "b", "new_b", "b_low", "b_high")
        gap = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
                         lambda x, y: F.greatest(x, y, F.lit(0.0)))
        apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        pairs = pairs.join(a, [*key, "a"]).join(b, [*key, "b"]).where((F.col("new_a") <= F.col("new_b")) & (apart <= reach)).select(
            *key, F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        pairs = stored(pairs, "ego-pairs")
    return pairs


def connections(pairs: DataFrame, segs: DataFrame, axes: np.ndarray, kind: str, threshold: float) -> DataFrame:
    """(node, links, first) of each vector with links inside a segment pair."""
    whole = segs.select("label", "dims", "seg", "nodes", "vectors", "copies")
    a = whole.toDF("label", "dims", "a", "a_nodes", "a_vectors", "a_copies")
    b = whole.toDF("label", "dims", "b", "b_nodes", "b_vectors", "b_copies")
    both = pairs.join(a, ["label", "dims", "a"]).join(b, ["label", "dims", "b"]).select(
        "a", "b", *a.columns[3:], *b.columns[3:])

    def run(batches):
        def found():
            for batch in batches:
                for r in batch.to_pylist():
                    ids = [np.frombuffer(r[f"{s}_nodes"], np.int64) for s in "ab"]
                    copies = [np.frombuffer(r[f"{s}_copies"], np.int64) for s in "ab"]
                    sides = [_Side(r[f"{s}_vectors"], len(n), kind, axes) for s, n in zip("ab", ids)]
                    same = r["a"] == r["b"]
                    p, q = join_sequences(*sides, same, threshold)
                    if not same:       # one numbering for both
                        q = q + len(ids[0])
                        ids, copies = [np.concatenate(ids)], [np.concatenate(copies)]
                    n = np.bincount(p, copies[0][q], len(ids[0])) + np.bincount(q, copies[0][p], len(ids[0]))
                    i = np.flatnonzero(n)
                    yield ids[0][i], n[i].astype(np.int64), ids[0][_roots(len(ids[0]), p, q)[i]]

        yield from emit(found(), ["node", "links", "first"], [pa.int64()] * 3)

    return both.mapInArrow(run, "node long, links long, first long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, grid_dims: int = GRID_DIMS, segment: int = SEGMENT) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0, at most 1")
    v = F.col("vector")
    usable = (F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
              & F.exists(v, lambda x: x != 0))
    src = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = src.where(usable)
    classes = stored(good.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("smallest"))
                     .withColumn("dims", F.size("vector")), "ego-classes")
    dims = classes.agg(F.max("dims")).first()[0] or 1
    axes = principal(classes, dims, grid_dims)
    reach = (2 - 2 * threshold) * (1 + SLACK) + SLACK
    placed, segs = segments(classes, axes, dims, max(math.sqrt(2 - 2 * threshold), 1e-6), segment)
    pairs = segment_pairs(segs, axes.shape[1], reach)
    kind = {"float": "float32", "double": "float64"}[classes.schema["vector"].dataType.elementType.typeName()]
    found = stored(connections(pairs, segs, axes, kind, threshold), "ego-connections")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
    named = stored(placed.select("label", "vector", "copies", "smallest", "node").join(links, "node", "left").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ego-named")
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "root").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = good.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = src.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
