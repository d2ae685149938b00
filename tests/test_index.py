"""Stored indexes: pruned searches equal full scans; an index follows its documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted as I
from tessera.operators import retrieval as R
from tessera.operators import slices as S
from tessera.session import scratch_path, table
from tessera.sources import index_store as IX
from tessera.sources import tables as TB

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_inverted_index_equals_the_scan(spark):
    chunks = spark.read.parquet(stored_chunks(spark))
    asked = table(spark, SF, "benchmark").select("item_id", "text").unionByName(
        spark.createDataFrame([(900, ""), (901, None), (902, "zzzunknown"), (903, "the zzzunknown the")], "item_id long, text string"))
    index = I.build(chunks)
    for k in (1, 3):
        hits, scored = I.knn(asked, index, k)
        assert rows(hits) == rows(R.knn_sparse(asked, chunks, k))
        assert scored.count() < table(spark, SF, "benchmark").count() * chunks.count()


def test_rare_words_prune_almost_all_rows(spark):
    rng = np.random.default_rng(1)
    text = [" ".join(["the"] * 8 + [f"w{i}" for i in rng.integers(0, 4000, 40)]) for _ in range(1500)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(i, text[i]) for i in range(0, 1500, 300)], "item_id long, text string")
    hits, scored = I.knn(asked, I.build(corpus), 1)
    assert rows(hits) == rows(R.knn_sparse(asked, corpus, 1))
    assert scored.count() < 0.1 * 5 * 1500


def stored_chunks(spark):
    path = scratch_path(spark, "test-chunks")
    R.build_chunks(table(spark, SF, "documents")).write.parquet(path)
    return path


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_slices_equal_the_scan_and_skip(spark, metric):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8)) * 20
    x = centre[np.minimum(rng.integers(0, 18, 900), 11)] + rng.normal(size=(900, 8))      # a third in one cluster
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 900, 100)] + [(9999, None)], "qid long, embedding array<double>")
    slices = S.build(corpus, slice_vectors=32)
    hits, read = S.knn(asked, slices, k=4, metric=metric, block_bytes=400)                # several blocks of queries
    assert rows(hits) == rows(R.knn_dense(asked.where("embedding is not null"), corpus.where("embedding is not null"), k=4, metric=metric))
    assert read.count() < (0.5 if metric == "l2" else 0.9) * slices.count() * 9
    assert S.knn(asked.limit(0), slices)[0].count() == 0


def test_more_hits_asked_than_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.5])], "qid long, embedding array<double>")
    assert rows(S.knn(asked, S.build(corpus), k=9)[0]) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 1.0)]


def test_only_differences_are_chunked(spark):
    root = scratch_path(spark, "test-index")
    docs = table(spark, SF, "documents").select("doc_id", "source", "text").orderBy("doc_id").limit(40)
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    first = IX.update(spark, root, docs)
    assert first == {"version": 1, "n_added": 40, "n_changed": 0, "n_removed": 0}
    before = rows(IX.read(spark, root))
    held = IX.read(spark, root, 1)                                     # a reader of the first version
    edited = docs.where(F.col("doc_id") != ids[0]).withColumn("text", F.when(F.col("doc_id") == ids[1], "edited text").otherwise(F.col("text")))
    after = edited.unionByName(spark.createDataFrame([(10**9, "new", "a new document")], "doc_id long, source string, text string"))
    assert IX.update(spark, root, after) == {"version": 2, "n_added": 1, "n_changed": 1, "n_removed": 1}
    now = rows(IX.read(spark, root))
    untouched = [r for r in before if r[1] not in (ids[0], ids[1])]
    assert [r for r in now if r[1] not in (ids[1], 10**9)] == untouched
    assert {r[3] for r in now if r[1] == ids[1]} == {"Title: " + docs.where(F.col("doc_id") == ids[1]).first().source + " edited text"}
    written = spark.read.parquet(f"{root}/segments/{IX.pointer(spark, root, 2)['segments'][-1]}")
    assert {r.doc_id for r in written.collect()} == {ids[1], 10**9}
    assert rows(held) == before
    assert IX.update(spark, root, after)["n_added"] == 0
    IX.compact(spark, root)
    assert rows(IX.read(spark, root)) == now and len({r[0] for r in now}) == len(now)


def test_two_writers_and_a_failed_one(spark):
    root = scratch_path(spark, "test-index")
    docs = spark.createDataFrame([(1, "s", "one two"), (2, "s", None), (3, None, "x")], "doc_id long, source string, text string")
    IX.update(spark, root, docs)
    IX.update(spark, root, docs.limit(1), base=1)
    with pytest.raises(IX.VersionConflict):
        IX.update(spark, root, docs.limit(2), base=1)
    broken = docs.withColumn("text", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        IX.update(spark, root, broken)
    assert IX.versions(spark, root) == [1, 2]


def test_a_failed_build_leaves_the_old_index(spark):
    path = scratch_path(spark, "test-index")
    good = spark.createDataFrame([(1, "a")], "chunk_id long, chunk_text string")
    TB.save_index(good, path)
    with pytest.raises(Exception, match="broken"):
        TB.save_index(good.withColumn("chunk_text", F.raise_error(F.lit("broken")).cast("string")), path)
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    TB.save_index(good.withColumn("chunk_id", F.lit(2)), path)
    assert spark.read.parquet(path).first().chunk_id == 2


def test_an_expired_mark_is_taken_over(spark):
    path = scratch_path(spark, "test-index")
    TB.save_index(spark.createDataFrame([(1, "a")], "chunk_id long, chunk_text string"), path)
    left = TB.single_writer(spark, path)
    left.__enter__()                                                   # a driver that died
    with pytest.raises(RuntimeError):
        with TB.single_writer(spark, path):
            pass
    with TB.single_writer(spark, path, expires_s=-1):
        pass
