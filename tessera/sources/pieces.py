"""Files of any size as tables of pieces, and back.

A file is rows (path, piece_no, data) of bounded size, so no row and no task holds it whole. Writing is a
Spark data source: each task streams the sorted pieces of its files to storage in a folder of its own attempt, and
the commit of the job moves the finished files to their names. A task that fails and runs again starts a
new folder; a job that fails removes its folders and leaves the files that were there before.
Reading lists the files by their metadata alone and reads ranges in tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.sources.files import qualified

PIECE_BYTES = 1 << 20
FORMAT = "tessera_pieces"


def _open(uri: str):
    """File system and path of a qualified folder, inside tasks."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].strip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    paths: list


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.job = options["path"], f".job-{options['job']}"

    def write(self, iterator: Iterator) -> Written:
        fs, base = _open(self.root)
        attempt = f"{base}/{self.job}/{uuid.uuid4().hex}"
        path, expected, out, done = None, 0, None, []
        try:
            for batch in iterator:
                for p, no, data in zip(*(batch.column(c).to_pylist() for c in ("path", "piece_no", "data"))):
                    if p != path:
                        if out is not None:
                            out.close()
                        if p is None or p.startswith("/") or ".." in p.split("/"):
                            raise ValueError(f"not a path below the folder: {p}")
                        path, expected = p, 0
                        fs.create_dir(f"{attempt}/{p}".rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(f"{attempt}/{p}")
                        done.append(p)
                    if no != expected:
                        raise ValueError(f"piece {expected} of {p} is missing")
                    out.write(data or b"")
                    expected += 1
        finally:
            if out is not None:
                out.close()
        return Written(attempt, done)

    def commit(self, messages: list) -> None:
        fs, base = _open(self.root)
        for m in messages:
            for p in m.paths if m else ():
                fs.create_dir(f"{base}/{p}".rsplit("/", 1)[0], recursive=True)
                fs.move(f"{m.attempt}/{p}", f"{base}/{p}")
        self._clean(fs, base)

    def abort(self, messages: list) -> None:
        self._clean(*_open(self.root))

    def _clean(self, fs, base: str) -> None:
        """Remove what this job's attempts have left, those of failed tasks too."""
        from pyarrow import fs as pafs
        if fs.get_file_info(f"{base}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")


class PieceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options)


def to_pieces(files: DataFrame, path_col: str, content_col: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, piece_no, data) of binary columns (narrow). An empty or null payload is one empty piece."""
    x = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit(b"").cast("binary")).alias("_d"))
    last = F.greatest(F.ceil(F.octet_length("_d") / piece_bytes).cast("int") - 1, F.lit(0))
    return x.select("path", "_d", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "path", "piece_no", F.substring("_d", F.col("piece_no") * piece_bytes + 1, piece_bytes).alias("data"))


def write_pieces(pieces: DataFrame, root: str) -> None:
    """Write every file of ``pieces`` (path below ``root``, piece_no from 0, data). Pieces of a file
    stream through one task; files are dealt out by path."""
    spark = pieces.sparkSession
    spark.dataSource.register(PieceFiles)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (pieces.select("path", F.col("piece_no").cast("int").alias("piece_no"), "data").repartition(n, "path").sortWithinPartitions("path", "piece_no")
     .write.format(FORMAT).option("path", qualified(spark, root)).option("job", uuid.uuid4().hex).mode("append").save())


def read_pieces(spark: SparkSession, root: str, piece_bytes: int = PIECE_BYTES, glob: str | None = None) -> DataFrame:
    """(path below ``root``, piece_no, data) of every file that is not empty (Spark's scans skip empty files). Only
    lengths are listed; each piece is a range read."""
    target = qualified(spark, root).rstrip("/")
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(root).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / piece_bytes).cast("int") - 1, F.lit(0))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))

    def run(batches):
        import pyarrow as pa
        fs, base = _open(target)
        name, f = None, None
        for b in batches:
            for r in b.to_pylist():
                path = f"{base}/{r['path'].split(base.rstrip('/') + '/', 1)[1]}"
                if path != name:
                    name, f = path, fs.open_input_file(path)
                at = r["piece_no"] * piece_bytes
                data = f.read_at(max(0, min(piece_bytes, r["length"] - at)), at)
                yield pa.RecordBatch.from_arrays([pa.array([path[len(base.rstrip("/")) + 1:]]), pa.array([r["piece_no"]], pa.int32()), pa.array([data], pa.binary())],
                                                 names=["path", "piece_no", "data"])

    return ranges.mapInArrow(run, "path string, piece_no int, data binary")
