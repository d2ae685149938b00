"""Helpers shared by the operators: session set-up, stored tables, files in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import apply_defaults, checkpoint_dir

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts make a batch heavy.
BATCH_ROWS = "8000"
BATCH_BYTES = "8388608"


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, and Arrow batches small enough for very long texts."""
    apply_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the cluster's shared scratch folder, fully qualified."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(conf).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and a
    lost executor never forces its recomputation."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it, so that it differs from all ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified URI, for use inside tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def emit(batches: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Column tuples to record batches."""
    for cols in batches:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _numbered_blocks(batches: Iterator[pa.RecordBatch], columns: list[str], block_bytes: int) -> Iterator[tuple[int, dict]]:
    """Rows of a task dealt into blocks of at most ``block_bytes`` of ``text`` (a longer text is a
    block of its own), as (number, lists by column)."""
    names = [*columns, "text"]
    held, size, number = {c: [] for c in names}, 0, TaskContext.get().partitionId() << 24
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in names}
        for i, text in enumerate(cols["text"]):
            if held["text"] and size + len(text) > block_bytes:
                yield number, held
                held, size, number = {c: [] for c in names}, 0, number + 1
            for c in names:
                held[c].append(cols[c][i])
            size += len(text)
    if held["text"]:
        yield number, held


class Blocks:
    """Rows dealt once into numbered blocks, each stored as one Parquet file. Every pass reads those
    files, so a block keeps its number and rows however Spark splits the input between passes, and
    what is kept by block meets its rows again without a shuffle. The list of files is a stored table."""

    def __init__(self, src: DataFrame, name: str, block_bytes: int):
        self.spark = src.sparkSession
        self.columns = [c for c in src.columns if c != "text"]
        root, columns = new_dir(self.spark, name), self.columns
        schema = pa.schema([src.select(*columns, "text").limit(0).toArrow().schema.field(c) for c in (*columns, "text")])

        def deal(batches):
            fs, path = open_fs(root)
            fs.create_dir(path, recursive=True)
            for number, cols in _numbered_blocks(batches, columns, block_bytes):
                # each attempt of a task has its own files; only those of the finished one are reported
                file = f"{path}/{number}-{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.table([pa.array(cols[f.name], f.type) for f in schema], schema=schema), file, filesystem=fs)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([file]), pa.array([sum(map(len, cols["text"]))])],
                                                 names=["number", "file", "size"])

        self.files = stored(src.select(*columns, "text").mapInArrow(deal, "number long, file string, size long"), f"{name}-files")
        self.count, self.text_bytes = self.files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.root = root

    def map(self, fn, schema, kept: tuple[Kept, ...] = ()) -> DataFrame:
        """``fn`` over (number, lists by column, *tables) of the blocks, one block a task; ``tables`` is
        what each of ``kept`` holds for the block (None if it holds nothing)."""
        root, columns, folders = self.root, [*self.columns, "text"], [k.folder for k in kept]
        files = self.files.drop("size")
        for i, k in enumerate(kept):
            rows = k.rows.select(F.col("block").alias("number"), F.col("n").alias(f"n{i}"))
            files = files.join(rows, "number", "left").fillna(0, [f"n{i}"])

        def run(batches):
            fs, _ = open_fs(root)

            def blocks():
                for b in batches:
                    for r in b.to_pylist():
                        t = pq.read_table(r["file"], filesystem=fs, partitioning=None)
                        cols = {c: t[c].to_pylist() for c in columns}
                        del t
                        yield r["number"], cols, *(block_table(f, r["number"], r[f"n{i}"]) for i, f in enumerate(folders))

            yield from fn(blocks())

        # as many ranges as numbers, which differ: one block a task, so that a task never holds two
        return files.repartitionByRange(max(1, self.count), "number").mapInArrow(run, schema)


class Kept:
    """``df`` written to a folder of the shared scratch, one subfolder for each value of ``block``, and
    the stored number of rows of each block, which readers hold against what they find."""

    def __init__(self, df: DataFrame, name: str):
        self.folder = new_dir(df.sparkSession, name)
        df.repartition("block").write.partitionBy("block").parquet(self.folder)
        written = df.sparkSession.read.schema(df.schema).parquet(self.folder)
        self.rows = stored(written.groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n")), f"{name}-rows")


def block_table(folder: str, number: int, rows: int) -> pa.Table | None:
    """What ``Kept`` wrote for one block, or None if that is nothing. Raises if rows are missing."""
    if not rows:
        return None
    fs, root = open_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/block={number}", allow_not_found=True))
    tables = [pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(f.path for f in found) if f.endswith(".parquet")]
    n = sum(t.num_rows for t in tables)
    if n != rows:
        raise RuntimeError(f"block {number} in {folder} has {n} rows, {rows} were written")
    return pa.concat_tables(tables)
