"""File scans: whole-text and binary files, listed and read in tasks; images with Spark's built-in source."""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.trainset import path_columns
from tessera.session import stored

OPEN_BYTES = 64 << 10     # cost of opening a file, in bytes read meanwhile
READ_BYTES = 8 << 20      # of files that a task hands on at once
LIST_ROWS = 10_000        # of a listing that a task hands on at once
# Fixed values that must equal the reference behaviour.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp"]   # matched in either case


def ext_filter(exts: list[str]) -> str:
    """Case-insensitive regex for paths ending in one of ``exts``."""
    return r"(?i)\.(" + "|".join(exts) + r")$"


def small_files(spark: SparkSession) -> SparkSession:
    """A session that takes an unread file for ``OPEN_BYTES`` more than it holds. With Spark's 4 MB, 32 small files
    fill a task, and tasks outnumber the work; a setting of the session's own is kept."""
    key = "spark.sql.files.openCostInBytes"
    if spark.conf.get(key, None) is not None:
        return spark
    other = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            other.conf.set(k, v)
    other.conf.set(key, str(OPEN_BYTES))
    return other


# What Hadoop's codecs read by the name's end; Spark's text source unpacks such files.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
ODD = re.compile(r"[^A-Za-z0-9\-_.!~*'():@&=+$,;/\x80-\U0010ffff]|[\x80-\x9f\s]")      # what Java quotes in the path of a URI
LISTED = "path string, uri string, length long, folder boolean"


@functools.cache
def _store(head: str) -> tuple[pafs.FileSystem, str]:
    """File system of ``scheme:`` or ``scheme://authority``, and what paths in it begin with."""
    if head.startswith("file:"):
        return pafs.LocalFileSystem(), ""
    store, base = pafs.FileSystem.from_uri(head)
    return store, base.rstrip("/")


def _parts(path: str) -> tuple[str, str]:
    """``scheme:`` or ``scheme://authority``, and the path below it, of a qualified path."""
    return re.fullmatch(r"([^:/]+:(?://[^/]*)?)(/.*)", path, re.DOTALL).groups()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    head, below = _parts(path)
    store, base = _store(head)
    return store, base + below


def _uri(path: str) -> str:
    """``path`` as ``input_file_name`` writes it: with an authority and quoted."""
    head, below = _parts(path)
    return (head if "//" in head else f"{head}//") + ODD.sub(lambda m: quote(m[0], safe=""), below)


def _entries(folder: str):
    """(name, length, folder?) of what a folder holds, one after the other where the file system allows."""
    store, at = _opened(folder)
    if not isinstance(store, pafs.LocalFileSystem):
        for i in store.get_file_info(pafs.FileSelector(at)):
            yield i.base_name, i.size or 0, i.type == pafs.FileType.Directory
        return
    with os.scandir(at) as found:
        for e in found:
            try:
                yield (e.name, 0, True) if e.is_dir() else (e.name, e.stat().st_size, False)
            except FileNotFoundError:               # gone meanwhile, or a link to nothing
                pass


def _hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _list(batches):
    def rows():
        for b in batches:
            for folder in b.column("path").to_pylist():
                for name, length, inner in _entries(folder):
                    if not _hidden(name):
                        path = f"{folder.rstrip('/')}/{name}"
                        yield path, _uri(path), length, inner

    found = rows()
    while some := list(itertools.islice(found, LIST_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                                         names=["path", "uri", "length", "folder"])


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame | None:
    """(path, uri, length) of the files that Spark's own scans read below ``path``: no hidden and no empty ones, and
    only those whose name fits ``glob``. Tasks list the folders, level by level, and store what they find, so the
    listing is a table and neither the driver nor a task holds it. None if ``path`` is nowhere, or in a store that
    tasks cannot open."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in files.globStatus(files.makeQualified(root)) or ()]
    try:
        level = [(p, _uri(p), n, inner) for p, n, inner in found if _opened(p)]
    except (OSError, ValueError, ImportError, NotImplementedError):
        return None
    if not level:
        return None
    levels, rows = [], spark.createDataFrame(level, LISTED)
    while rows is not None:
        levels.append(stored(rows, "listing"))
        inner = levels[-1].filter("folder")
        if not recursive and len(levels) > 1:
            inner = inner.filter(F.substring_index("path", "/", -1).contains("="))       # partitions of one table
        n = inner.count()
        rows = inner.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_list, LISTED) if n else None
    name = F.substring_index("path", "/", -1)
    out = functools.reduce(DataFrame.unionAll, levels).filter(~F.col("folder") & (F.col("length") > 0) & ~name.rlike(r"^(\.|_[^=]*$)"))
    if glob:
        out = out.filter(name.rlike(rf"^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})\z"))
    return out.select("path", "uri", "length")


def _dealt(files: DataFrame) -> DataFrame:
    """Listed files dealt to as many tasks as Spark's scan would make, a file of ``OPEN_BYTES`` more than it holds."""
    spark = files.sparkSession
    conf = small_files(spark)._jsparkSession.sessionState().conf()
    opening = conf.filesOpenCostInBytes()
    size = files.agg(F.coalesce(F.sum(F.col("length") + opening), F.lit(0))).first()[0]
    task = min(conf.filesMaxPartitionBytes(), max(opening, size / spark.sparkContext.defaultParallelism))
    return files.repartition(max(1, math.ceil(size / task)), "path")


@F.arrow_udf(T.BinaryType())
def _content(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What the files hold, handed on by at most ``READ_BYTES`` and one file."""
    for batch in paths:
        held, size = [], 0
        for p in batch.to_pylist():
            store, at = _opened(p)
            with open(at, "rb") if isinstance(store, pafs.LocalFileSystem) else store.open_input_stream(at, compression=None) as f:
                held.append(f.read())
            size += len(held[-1])
            if size >= READ_BYTES:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.binary())


def read_text_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, text): every file as one UTF-8 document. Spark's ``wholetext`` source, whose listing the driver holds,
    reads the folder if there are packed files, or if tasks cannot open it."""
    files = list_files(spark, path, glob, recursive)
    if files is not None and files.filter(F.col("path").rlike(PACKED)).isEmpty():
        return _dealt(files).select(F.col("uri").alias("path"), _content("path").cast("string").alias("text"))
    r = small_files(spark).read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    # text() sets wholetext itself, so it must be passed there, not as an option
    return r.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True,
                      ext_regex: str | None = None) -> DataFrame:
    """(path, length, content, ext, stem, label). ``content`` is only read when selected. Spark's ``binaryFile``
    source, whose listing the driver holds, reads the folder if tasks cannot open it."""
    df = list_files(spark, path, glob, recursive)
    own = df is None
    if own:
        r = small_files(spark).read.format("binaryFile").option("recursiveFileLookup", recursive)
        if glob:
            r = r.option("pathGlobFilter", glob)
        df = r.load(path)
    if ext_regex:
        df = df.filter(F.col("path").rlike(ext_regex))
    return path_columns(df.select("path", "length", "content") if own else _dealt(df).select("path", "length", _content("path").alias("content")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, n_channels, mode, data, ok): decoded images; undecodable files
    are kept as rows with ok = false so a bad file does not stop the job."""
    img = (small_files(spark).read.format("image").option("dropInvalid", False)
           .option("recursiveFileLookup", True).load(path))
    i = F.col("image")
    return img.select(i.origin.alias("path"), i.height.alias("height"), i.width.alias("width"),
                      i.nChannels.alias("n_channels"), i.mode.alias("mode"), i.data.alias("data"),
                      (i.nChannels > 0).alias("ok"))


def count_good_bad(df: DataFrame, ok: str = "ok") -> DataFrame:
    return df.agg(F.count(F.when(F.col(ok), 1)).alias("n_ok"), F.count(F.when(~F.col(ok), 1)).alias("n_failed"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system Spark resolves it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_files(df: DataFrame, root: str, name_col: str, content_col: str) -> DataFrame:
    """Write each row's binary ``content_col`` as the file ``root/name_col`` (lazy).

    Spark has no raw-bytes file sink, so tasks write through ``pyarrow.fs`` to the very file
    system that Spark resolves ``root`` to (a path without scheme included). A file appears by
    renaming once it is whole, and a rerun of a task rewrites the same names, so retries are
    idempotent. Returns (path, n_bytes) rows; run an action to perform the writes.
    """
    target = qualified(df.sparkSession, root)

    def write(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        if target.startswith("file:"):
            filesystem, base = fs.LocalFileSystem(), "/" + target[len("file:"):].strip("/")
        else:
            filesystem, base = fs.FileSystem.from_uri(target)
        made = set()
        for pdf in batches:
            paths, sizes = [], []
            for name, data in zip(pdf[name_col], pdf[content_col]):
                p = f"{base.rstrip('/')}/{name}"
                folder = p.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                temp = f"{folder}/.{uuid.uuid4().hex}.tmp"
                with filesystem.open_output_stream(temp) as f:
                    f.write(bytes(data))
                filesystem.move(temp, p)
                paths.append(p)
                sizes.append(len(data))
            yield pd.DataFrame({"path": paths, "n_bytes": sizes})

    return df.select(name_col, content_col).mapInPandas(write, "path string, n_bytes long")
