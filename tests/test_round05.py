"""Findings of round 4."""

import gzip

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessera.sources import files as FS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, folder, texts):
    """A table folder whose documents are ``texts``, numbered from 0."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_gzip_of_empty_and_null_texts(spark, tmp_path):
    """an empty text has no share to save, a null one no bytes; neither ends the query."""
    texts = ["abc " * 50, "", None, "é", ""]
    sf = documents(spark, tmp_path, texts)
    got = {r.doc_id: r for r in queries()["gzip_corpus"](spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert (got[i].original_bytes, got[i].gzip_bytes, got[i].ratio, got[i].space_saved_pct) == (None, None, 0.0, 0.0)
            continue
        n, c = len(t.encode()), len(gzip.compress(t.encode(), 9, mtime=0))
        want = (n, c, round(n / c, 6), round(100 * (1 - c / n), 4) if n else 0.0)
        assert (got[i].original_bytes, got[i].gzip_bytes, got[i].ratio, got[i].space_saved_pct) == want
    assert {r.doc_id: r.text for r in queries()["gunzip_corpus"](spark, sf).collect()} == dict(enumerate(texts))


NAMES = ["a_1.txt", "b.TXT", "x y%#?[1]{2}^é 漢.txt", "k=v/c_2.txt", "k=w/d.txt", "deep/er/e.txt", "part/k=v/f.txt", "part/k=w/g.txt", "_k=x/g.txt",
         "deep/g.bin", "deep/odd~!'()&+,;@$.txt", "empty.txt", "_h.txt", ".h.txt", "_hid/h.txt", ".hid/h.txt", "z.txt._COPYING_", "deep/_metadata"]


def tree(root):
    """Files of odd names and contents below ``root``, and (path, glob, recursive) of scans of them."""
    for i, name in enumerate(NAMES):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else f"text {i}\n".encode() + b"\xff\r\n\x00" * i)
    (root / "nothing").mkdir()
    (root / "deep" / "broken.txt").symlink_to(root / "nowhere")
    (root / "linked").symlink_to(root / "k=v")
    return [(str(root), None, True), (str(root), "[a-g]*.{txt,TXT}", True), (str(root / "deep"), None, False), (str(root / "part"), "?.txt", False),
            (str(root / "k=v" / "c_2.txt"), None, True), (str(root / "*p"), "*.txt", True)]


def plain(spark, glob, recursive):
    r = spark.read.option("recursiveFileLookup", recursive)
    return r.option("pathGlobFilter", glob) if glob else r


def rows(df, content):
    return sorted((r.path, bytes(r.content)) for r in df.select("path", F.col(content).cast("binary").alias("content")).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_scans_list_in_tasks(spark, tmp_path):
    """the rows of Spark's own source, whose listing the driver holds, from a listing that is a table."""
    for at, glob, recursive in tree(tmp_path):
        got = FS.read_text_files(spark, at, glob, recursive)
        assert "ArrowEvalPython" in plan(got) and "FileScan text" not in plan(got)
        assert rows(got, "text") == rows(plain(spark, glob, recursive).text(at, wholetext=True).withColumn("path", F.input_file_name()), "value")
    (tmp_path / "deep" / "packed.txt.gz").write_bytes(gzip.compress(b"unpacked"))
    assert "unpacked" in {r.text for r in FS.read_text_files(spark, str(tmp_path / "deep")).collect()}
    with pytest.raises(AnalysisException):
        FS.read_text_files(spark, str(tmp_path / "nowhere"))


def test_listings_and_contents_are_handed_on_in_parts(tmp_path, monkeypatch):
    """a task holds neither the names of a large folder nor the contents of many files."""
    for i in range(25):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * 100)
    monkeypatch.setattr(FS, "LIST_ROWS", 10)
    listed = list(FS._list([pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}"])], names=["path"])]))
    assert [b.num_rows for b in listed] == [10, 10, 5]
    monkeypatch.setattr(FS, "READ_BYTES", 300)
    paths = pa.chunked_array([b.column("path") for b in listed]).combine_chunks()
    assert [len(a) for a in FS._content.func(iter([paths]))] == [3] * 8 + [1]


def test_binary_scans_list_in_tasks(spark, tmp_path):
    """likewise for binary files; contents are read only where they are selected."""
    for at, glob, recursive in tree(tmp_path):
        got = FS.read_binary_files(spark, at, glob, recursive)
        assert "ArrowEvalPython" in plan(got) and "FileScan binaryFile" not in plan(got)
        assert "ArrowEvalPython" not in plan(got.select("path", "length"))
        assert rows(got, "content") == rows(plain(spark, glob, recursive).format("binaryFile").load(at), "content")
    assert FS.read_binary_files(spark, str(tmp_path), ext_regex=FS.ext_filter(["BIN"])).select("label", "length").collect() == [("g.bin.bin", 43)]
    with pytest.raises(AnalysisException):
        FS.read_binary_files(spark, str(tmp_path / "nowhere"))
