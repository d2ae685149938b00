"""File sources and table sinks."""

import struct

from pyspark.sql import functions as F

from tessera.sources import files as FS
from tessera.sources import tables as TB


def _bmp(width, height, rgb=(10, 20, 30)):
    row = bytes(rgb[::-1]) * width
    row += b"\x00" * ((4 - len(row) % 4) % 4)
    pixels = row * height
    header = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(pixels), 2835, 2835, 0, 0)
    return header + info + pixels


def test_read_images_counts_bad_files(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(_bmp(5, 3))
    (tmp_path / "b.BMP").write_bytes(_bmp(2, 2))
    (tmp_path / "c.png").write_bytes(b"not an image")
    imgs = FS.read_images(spark, str(tmp_path))
    c = FS.count_good_bad(imgs).collect()[0]
    assert (c.n_ok, c.n_failed) == (2, 1)
    sizes = sorted((r.width, r.height) for r in imgs.filter("ok").collect())
    assert sizes == [(2, 2), (5, 3)]


def test_text_and_binary_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x_1.txt").write_text("hello\nworld")
    (tmp_path / "d" / "y_2.TXT").write_text("again")
    (tmp_path / "d" / "z.bin").write_bytes(b"\x00\x01")
    t = FS.read_text_files(spark, str(tmp_path / "d"), glob="*.txt")
    assert [r.text for r in t.collect()] == ["hello\nworld"]
    b = FS.read_binary_files(spark, str(tmp_path), ext_regex=FS.ext_filter(["txt"]))
    assert sorted((r.label, r.length) for r in b.collect()) == [("x.txt", 11), ("y.TXT", 5)]


def test_index_store_roundtrip(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "s", "a b c"), (2, "s", "d e")], "doc_id long, source string, text string")
    built = TB.load_or_build_index(spark, path, lambda: __import__("tessera.operators.retrieval", fromlist=["x"]).build_chunks(docs))
    assert sorted(r.chunk_id for r in built.collect()) == [0, 1]
    more = spark.createDataFrame([(3, "s", "f")], "doc_id long, source string, text string")
    TB.append_index(spark, path, more)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    import pytest
    with TB.single_writer(spark, path), pytest.raises(RuntimeError):
        TB.append_index(spark, path, more)
    assert spark.read.parquet(path).count() == 3
    # stored index is reused, not rebuilt
    again = TB.load_or_build_index(spark, path, lambda: (_ for _ in ()).throw(AssertionError("rebuilt")))
    assert again.count() == 3


def test_metrics_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for e in range(3):
        TB.append_metrics_log(spark.createDataFrame([(e, 0.5 + e / 10)], "epoch int, acc double"), path)
    assert spark.read.parquet(path).agg(F.count("*")).collect()[0][0] == 3


def test_bmp_write_and_read_pixels(spark, tmp_path):
    import numpy as np
    from tessera.operators import media as MD

    rng = np.random.default_rng(3)
    rows = []
    for i, (w, h) in enumerate([(5, 3), (64, 2), (7, 7)]):
        rows.append((i, w, h, bytes(rng.integers(0, 256, w * h, dtype=np.uint8))))
    img = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    bmp = img.select(F.concat(F.lit("i"), F.col("id").cast("string"), F.lit(".bmp")).alias("name"),
                     MD.bmp_blob("pixels", "width", "height").alias("blob"))
    assert FS.write_files(bmp, str(tmp_path / "img"), "name", "blob").count() == 3
    got = {r.path.rsplit("/", 1)[-1]: r for r in FS.read_images(spark, str(tmp_path / "img")).collect()}
    for i, w, h, px in rows:
        r = got[f"i{i}.bmp"]
        assert (r.width, r.height, r.n_channels, r.ok) == (w, h, 3, True)
        assert bytes(r.data)[::3] == px          # stored BGR, top row first
