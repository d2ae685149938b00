"""A versioned chunk index that follows its documents.

    <root>/segments/<name>    chunks (chunk_id, doc_id, chunk_no, chunk_text) as one update wrote them
    <root>/live/<name>        the documents of a version: doc_id, hash, segment that holds their chunks
    <root>/versions/<n>       pointer: names of the version's live table and segments, and the next chunk id

An update hashes every document and compares the hashes with the live ones by joins: only new and changed
documents are chunked; chunks of changed and removed documents stay in their segment but are no longer live.
A version appears by creating its pointer, which fails if another writer has made that version meanwhile; a
failed update leaves nothing but unused folders, and readers keep the version they opened.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.session import stored

EMPTY_POINTER_S = 60      # a pointer without content that old belongs to a writer that died


class VersionConflict(RuntimeError):
    """Another writer has made the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getLen() > 0 and s.getPath().getName().isdigit())


def pointer(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/versions/{version}").collect()))


def _commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    fs, p = _fs(spark, f"{root}/versions/{version}")
    if fs.exists(p):
        status = fs.getFileStatus(p)
        if status.getLen() or time.time() - status.getModificationTime() / 1000 < EMPTY_POINTER_S:
            raise VersionConflict(f"version {version} of {root} was made by another writer")
        fs.delete(p, False)
    try:
        out = fs.create(p, False)
    except Exception as e:      # created between the two calls
        raise VersionConflict(f"version {version} of {root} was made by another writer") from e
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def _live(spark: SparkSession, root: str, at: dict | None) -> DataFrame:
    if at is None:
        return spark.createDataFrame([], "doc_id long, hash string, segment string")
    return spark.read.parquet(f"{root}/live/{at['live']}")


def update(spark: SparkSession, root: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           title_col: str = "source", base: int | None = None) -> dict:
    """Make the index hold exactly ``docs`` (unique ids): new and changed documents are chunked, chunks of changed and
    removed ones are dropped, all others stay as they are. ``base`` is the version to start from (the
    last one); committing after another writer raises VersionConflict. Returns version, n_added, n_changed, n_removed."""
    known = versions(spark, root)
    base = base if base is not None else (known[-1] if known else 0)
    at = pointer(spark, root, base) if base else None
    name = f"{base + 1}-{uuid.uuid4().hex[:12]}"
    part = lambda c: F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-"))
    found = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.concat(part(title_col), part(text_col)), 256).alias("hash")), "hashes")
    old = _live(spark, root, at)
    fresh = stored(found.join(old.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti"), "fresh")
    same = old.join(found, ["doc_id", "hash"], "left_semi")
    gone = old.join(found, "doc_id", "left_anti").count()
    n_fresh, n_changed = fresh.count(), fresh.join(old.select("doc_id"), "doc_id", "left_semi").count()
    next_id = at["next_id"] if at else 0
    todo = docs.withColumn(id_col, F.col(id_col).cast("long")).join(fresh.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    R.build_chunks(todo, start_id=next_id, id_col=id_col, text_col=text_col, title_col=title_col).write.parquet(f"{root}/segments/{name}")
    last = spark.read.parquet(f"{root}/segments/{name}").agg(F.max("chunk_id")).first()[0]
    same.select("doc_id", "hash", "segment").unionByName(fresh.withColumn("segment", F.lit(name))).write.parquet(f"{root}/live/{name}")
    segments = [*(at["segments"] if at else []), name]
    _commit(spark, root, base + 1, {"live": name, "segments": segments, "next_id": next_id if last is None else last + 1})
    return {"version": base + 1, "n_added": n_fresh - n_changed, "n_changed": n_changed, "n_removed": gone}


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live chunks (chunk_id, doc_id, chunk_no, chunk_text) of a version, by default the last one."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no index in {root}")
    at = pointer(spark, root, version or known[-1])
    parts = [spark.read.parquet(f"{root}/segments/{s}").withColumn("segment", F.lit(s)) for s in at["segments"]]
    chunks = parts[0]
    for p in parts[1:]:
        chunks = chunks.unionByName(p)
    live = _live(spark, root, at).select("doc_id", "segment")
    return chunks.join(live, ["doc_id", "segment"], "left_semi").select("chunk_id", "doc_id", "chunk_no", "chunk_text")


def compact(spark: SparkSession, root: str) -> dict:
    """A new version whose live chunks stand in one segment, under the same ids."""
    base = versions(spark, root)[-1]
    at = pointer(spark, root, base)
    name = f"{base + 1}-{uuid.uuid4().hex[:12]}"
    read(spark, root, base).write.parquet(f"{root}/segments/{name}")
    _live(spark, root, at).withColumn("segment", F.lit(name)).write.parquet(f"{root}/live/{name}")
    _commit(spark, root, base + 1, {"live": name, "segments": [name], "next_id": at["next_id"]})
    return {"version": base + 1}
