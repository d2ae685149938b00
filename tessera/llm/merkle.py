"""Merkle dataset manifest with incremental witnesses.

Rows are leaves of one tree per language; the subroots are leaves of one tree above. Nodes of a
tree are appended in order, eight to a run. An appended node stays *open* until its run is full: then the run
becomes one node of the next level, and every leaf below each of its members gets the others as
the next step of its *witness* (the digests left and right of its path). A witness is thus never
searched for, it is finished by the siblings that arrive later.

Distributed, a block of ``8 ** 4`` nodes that starts at a multiple of its size is appended in one
task; its run boundaries are those of the whole tree, so it ends as exactly one node four levels up.
Block roots are appended in the same way as the next round's nodes (three rounds hold 6.9e10 leaves),
and their witnesses extend those of their leaves by a join on (tree, block). Subroots are a
further append. No step gathers more than one block; no driver holds digests of leaves.

Texts are hashed where they are read and never shuffled. Leaves are ordered by (tree, id, digest) in
a range-partitioned, stored table; equal rows are spread by a row number, which cannot change any result,
since their digests are equal.

Null fields are hashed as ``-``; null ids and null languages come first, null languages are one
tree. Repeated rows are leaves of their own. An empty table gives no rows. Fields are hashed by
name: extra columns change nothing and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.ordering import assign_consecutive_ids, in_order

FAN = 8                                                   # fixed value
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value
BLOCK_LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<left string, right string>>"


def field_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields one after another: ``-``, or length in bytes, colon, value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def digest(hex_digests: Iterator[str] | list[str]) -> str:
    return hashlib.sha256("".join(hex_digests).encode()).hexdigest()


class Append:
    """Streaming append of one block: open runs by level, witnesses by leaf."""

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.open: list[list[tuple[str, int, int]]] = []     # (node, first leaf, end leaf) of each level's open run
        self.size: list[int] = []                            # nodes of each level so far
        self.witness: list[list[tuple[str, str]]] = []

    def leaf(self, node: str) -> None:
        self.witness.append([])
        self._add(0, (node, len(self.witness) - 1, len(self.witness)))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
            self.size.append(0)
        self.open[level].append(node)
        self.size[level] += 1
        if len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [r[0] for r in run]
        for k, (_, first, end) in enumerate(run):
            step = ("".join(names[:k]), "".join(names[k + 1:]))
            for i in range(first, end):
                self.witness[i].append(step)
        self._add(level + 1, (digest(names), run[0][1], run[-1][2]))

    def close(self, levels: int | None) -> str:
        """Complete what is open: up to ``levels``, or until one node is left."""
        level = 0
        while level != levels if levels is not None else self.size[level] > 1:
            if level < len(self.open) and self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def append_blocks(nodes: DataFrame, keep: list[str], fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Append ``nodes`` (tree, number in the tree, size of the tree, node) block by block: ``keep``, tree, block,
    steps of each node's partial witness, and on the first row of a block its root and the number of blocks."""
    block = fan ** levels
    src = nodes.select(*dict.fromkeys([*keep, "tree", "size", "number", "node"]), F.floor(F.col("number") / block).cast("long").alias("block"))
    out = src.select(*keep, "tree", "block").withColumns(
        {"steps": F.lit(None).cast(STEPS), "root": F.lit(None).cast("string"), "blocks": F.lit(None).cast("long")}).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("number")
        app = Append(fan)
        for node in group["node"].to_pylist():
            app.leaf(node)
        size = group["size"][0].as_py()
        root = app.close(levels if size > block else None)
        n = group.num_rows
        steps = pa.array([[{"left": a, "right": b} for a, b in w] for w in app.witness],
                         pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        first = lambda v, t: pa.array([v] + [None] * (n - 1), t)
        cols = {c: group[c] for c in (*keep, "tree", "block")}
        return pa.table({**cols, "steps": steps, "root": first(root, pa.string()), "blocks": first(-(-size // block), pa.int64())})

    return src.groupBy("tree", "block").applyInArrow(run, out)


def climb(nodes: DataFrame, keep: list[str], fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of appends until every tree is one node: the rounds' tables, and (tree, root)."""
    rounds, ended = [], None
    while True:
        done = stored(append_blocks(nodes, keep if not rounds else ["number"], fan, levels), "merkle-round")
        rounds.append(done)
        tops = done.where("root is not null").select("tree", F.col("block").alias("number"), F.col("blocks").alias("size"), F.col("root").alias("node"))
        own = tops.where("size = 1").select("tree", F.col("node").alias("root"))
        ended = own if ended is None else ended.union(own)
        nodes = tops.where("size > 1")
        if nodes.limit(1).count() == 0:
            return rounds, ended


def descend(rounds: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """Whole witnesses of the first round's nodes, from the last round down: ``keep``, steps, end.
    ``above``: (tree, steps, end) of each tree's root; ``end`` is handed down to its leaves."""
    outer = None          # (tree, number, steps, end) of the round above
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k]
        ends = own.where("blocks = 1").select("tree", "block").join(above, "tree").select("tree", "block", F.col("steps").alias("more"), "end")
        if outer is not None:
            ends = ends.union(outer.select("tree", F.col("number").alias("block"), F.col("steps").alias("more"), "end"))
        cols = keep if k == 0 else ["tree", "number"]
        outer = own.join(ends, ["tree", "block"]).select(*cols, F.concat("steps", "more").alias("steps"), "end")
    return outer


def numbered(leaves: DataFrame, tree_col: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with tree (number of the tree in order), size and number in it; and (tree, name)."""
    rows = in_order(leaves, [tree_col, *order])
    counts = stored(rows.groupBy("__part", tree_col).agg(F.count("*").alias("n"), F.min("__pos").alias("first")), "merkle-counts")
    trees = assign_consecutive_ids(counts.groupBy(tree_col).agg(F.sum("n").alias("size")), [tree_col], out="tree")
    earlier = Window.partitionBy(tree_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    t = trees.withColumnRenamed(tree_col, "__tree")
    counts = counts.join(t, F.col(tree_col).eqNullSafe(F.col("__tree"))).select(
        F.col("__part").alias("__p"), F.col(tree_col).alias("__t"), "tree", "size", "before")
    # one row a stored partition and tree, so no partition of the join outgrows a stored one
    rows = rows.join(counts, (F.col("__part") == F.col("__p")) & F.col(tree_col).eqNullSafe(F.col("__t")))
    return rows.withColumn("number", F.col("__pos") + F.col("before")).drop("__part", "__pos", "__p", "__t", "before"), trees


def proof_digest(steps: str) -> Column:
    """SHA-256 of all siblings of a witness."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.left, s.right)), ""), 256)


def folded(leaf: Column, steps: str) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
             tampered: Column | None = None, fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row: id, leaf, seen (digest of the row as it is found when checked), subroot, root,
    steps (the whole witness). ``tampered``: the text as found later, the text itself if None."""
    one = {f: F.col(f) for f in fields}
    seen = {**one, text_col: F.col(text_col) if tampered is None else tampered}
    leaves = stored(docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("name"), field_digest(one).alias("node"),
                                field_digest(seen).alias("seen"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    rows, _ = numbered(leaves, "name", ["id", "node", "row"])
    keep = ["id", "node", "seen"]
    rounds, subroots = climb(rows, keep, fan, levels)
    # (tree, subroot) are numbered already: the tree's number is its place among the subroots
    subroots = stored(subroots, "merkle-subroots")
    # a tree's number is its place among the subroots
    top = subroots.join(F.broadcast(subroots.agg(F.count("*").alias("size")))).select(
        F.lit(0).cast("long").alias("tree"), "size", F.col("tree").alias("number"), F.col("root").alias("node"))
    top_rounds, end = climb(top, ["number"], fan, levels)
    up = descend(top_rounds, end.select("tree", F.array().cast(STEPS).alias("steps"), F.col("root").alias("end")), ["number"])
    above = subroots.join(up, F.col("tree") == F.col("number")).select(
        "tree", "steps", F.struct(F.col("root").alias("subroot"), F.col("end").alias("root")).alias("end"))
    return descend(rounds, above, keep).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "seen", "end.subroot", "end.root", "steps")
