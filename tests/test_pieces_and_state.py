"""Files as pieces, hash-tree verification, keyed streaming state, table functions."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import sqltables
from tessera.operators import patches as P
from tessera.session import scratch_path
from tessera.sources import pieces as PC
from tessera.streaming import running as RN


def local(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def test_files_in_pieces(spark):
    big = os.urandom(1_000_003)
    files = spark.createDataFrame([("a/big.bin", bytearray(big)), ("b.bin", bytearray(b"")), ("c/d/e", None), ("f", bytearray(b"x" * 64))], "path string, content binary")
    root = scratch_path(spark, "test-files")
    PC.write_pieces(PC.to_pieces(files, "path", "content", 4096), root)
    with open(local(root) + "/a/big.bin", "rb") as f:
        assert f.read() == big
    back = {}
    for r in PC.read_pieces(spark, root, 10_000).orderBy("path", "piece_no").collect():
        back[r.path] = back.get(r.path, b"") + bytes(r.data)
    assert back == {"a/big.bin": big, "f": b"x" * 64}
    assert os.path.getsize(local(root) + "/b.bin") == os.path.getsize(local(root) + "/c/d/e") == 0
    assert not [x for x in os.listdir(local(root)) if x.startswith(".job")]


def test_a_failed_job_leaves_the_files_that_were_there(spark):
    root = scratch_path(spark, "test-files")
    pieces = spark.createDataFrame([("a", i, bytearray(b"0" * 100)) for i in range(50)] + [("b", 0, bytearray(b"1"))], "path string, piece_no int, data binary")
    PC.write_pieces(pieces, root)
    with pytest.raises(Exception, match="piece 7 of a is missing"):
        PC.write_pieces(pieces.where("piece_no <> 7").withColumn("data", F.lit(b"2").cast("binary")), root)
    with open(local(root) + "/a", "rb") as f:
        assert f.read() == b"0" * 5000
    assert sorted(os.listdir(local(root))) == ["a", "b"]
    with pytest.raises(Exception, match="not a path below"):
        PC.write_pieces(spark.createDataFrame([("../x", 0, bytearray(b""))], "path string, piece_no int, data binary"), root)


def test_first_difference_by_hashes(spark):
    base = bytearray(os.urandom(200_000))

    def changed(at):
        b = bytearray(base)
        b[at] ^= 1
        return b

    cases = [(base, base, None), (base, changed(0), 1), (base, changed(65_535), 65_536), (base, changed(65_536), 65_537), (base, changed(199_999), 200_000),
             (base, base[:-1], 200_000), (base[:65_536], base[:65_537], 65_537), (bytearray(), bytearray(b"x"), 1), (bytearray(), bytearray(), None),
             (base, None, None), (None, base, None), (changed(131_072 + 255), base, 131_328)]
    a = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "id long, data binary")
    b = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(cases)], "id long, data binary")
    got = {r.id: r for r in P.verify_roundtrip(a, b, "id").collect()}
    for i, (x, y, first) in enumerate(cases):
        assert got[i].first_diff == first and got[i].equal == (x is not None and x == y), i
    assert all(r.equal and r.first_diff is None for r in P.verify_roundtrip(a.where("data is not null"), a.where("data is not null"), "id").collect())


def test_state_over_unsorted_batches(spark):
    rows = [(f"s{i % 3}" if i % 2 else "hot", i * 37 % 200, i + 1, (i % 7) + 1) for i in range(200)]
    path = scratch_path(spark, "test-stream")
    for k in range(4):
        spark.createDataFrame(rows[k::4], "source string, doc_id long, o long, c long").coalesce(1).write.mode("append").parquet(path)
    out = RN.stream_running_ratio(spark, path, (F.col("o"), F.col("c")), max_files=1, state_partitions=2)
    got = spark.read.parquet(out).collect()
    assert len(got) == 200 and len({r.batch_id for r in got}) == 4
    by_id = {r[1]: r for r in rows}
    for source in ("hot", "s0", "s1", "s2"):
        n = o = c = 0
        for r in sorted((r for r in got if r.source == source), key=lambda r: (r.batch_id, r.doc_id)):
            n, o, c = n + 1, o + by_id[r.doc_id][2], c + by_id[r.doc_id][3]
            assert (r.n_items, r.cum_original_bytes, r.cum_compressed_bytes) == (n, o, c) and abs(r.running_ratio - o / c) < 1e-12
    last = {r.source: r.n_items for r in RN.last_totals(spark, out, "source").collect()}
    assert sum(last.values()) == 200 and last["hot"] == 100


def test_table_functions_need_no_join(spark):
    sqltables.register(spark)
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "id long, t string")
    df.createOrReplaceTempView("texts_for_test")
    q = spark.sql("SELECT id, c.* FROM texts_for_test, LATERAL chunks_of(t, 3, 1) c")
    assert sorted(map(tuple, q.collect())) == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e")]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert spark.sql("SELECT p.* FROM texts_for_test, LATERAL patches_of(encode(t, 'UTF-8')) p WHERE id = 1").collect()[0].patch == b"a b c d e"
    assert spark.sql("SELECT p.* FROM texts_for_test, LATERAL records_of(encode(t, 'UTF-8')) p").collect() == []
