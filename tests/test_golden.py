"""Golden rows derived by reading the reference code (FIXTURES.md section 3)."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.functions import text as T
from tessera.operators import lm, media as MD, metrics as M, ordering as O, patches as P, retrieval as R, trainset as TS


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("n_words,n_chunks", [(0, 0), (1, 1), (224, 1), (225, 2), (256, 2), (448, 2), (449, 3)])
def test_chunk_counts(spark, n_words, n_chunks):
    text = " ".join(f"w{i}" for i in range(1, n_words + 1))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = R.chunk_documents(docs, title_col=None).orderBy("chunk_no").collect()
    assert len(rows) == n_chunks
    if n_words == 256:
        assert rows[1].chunk_text.split() == [f"w{i}" for i in range(225, 257)]


def test_chunk_unicode_separators(spark):
    docs = spark.createDataFrame([(1, "a b\u001cc  d\n")], "doc_id long, text string")
    assert R.chunk_documents(docs, title_col=None).collect()[0].chunk_text == "a b c d"


def test_compose_preview_guard(spark):
    assert one(spark, T.compose_title(F.lit("T"), F.lit("X"))) == "Title: T\nX"
    assert one(spark, T.preview(F.lit("a" * 200))) == "a" * 200
    assert one(spark, T.preview(F.lit("a" * 201))) == "a" * 200 + "..."
    assert one(spark, T.guard_status(F.lit("  "))) == "empty"
    assert one(spark, T.guard_status(F.lit("\n\t\u00a0\x1c"))) == "empty"
    assert one(spark, T.guard_status(F.lit("x" * 50000))) == "ok"
    assert one(spark, T.guard_status(F.lit("x" * 50001))) == "too_long"


def test_bits_and_bytes(spark):
    r = one(spark, B.bits_to_bytes(F.lit("101")))
    assert (bytes(r.data), r.pad) == (b"\x05", 5)
    r = one(spark, B.bits_to_bytes(F.lit("")))
    assert (bytes(r.data), r.pad) == (b"", 0)
    r = one(spark, B.bits_to_bytes(F.lit("11111111")))
    assert (bytes(r.data), r.pad) == (b"\xff", 0)
    assert one(spark, B.bytes_to_bits(F.unhex(F.lit("05")), F.lit(5))) == "101"
    assert one(spark, B.shift_right(B.to_ints(F.unhex(F.lit("FF01"))))) == [0x7F, 0x00]
    v = B.to_ints(F.unhex(F.lit("4180")))
    assert one(spark, B.mask_msb(v)) == [0x41, 0x00]
    assert one(spark, B.count_non_ascii(v)) == 1


def test_write_blocks_header(spark):
    blob = one(spark, B.block_blob(F.lit(3), F.lit(258), F.unhex(F.lit("FF"))))
    assert bytes(blob) == bytes([3, 1, 2, 0xFF])
    assert one(spark, B.block_status(F.lit(8), F.lit(1), F.unhex(F.lit("FF")))) == "bad_pad"
    assert one(spark, B.block_status(F.lit(0), F.lit(65536), F.unhex(F.lit("FF")))) == "bad_length"
    r = one(spark, B.read_block(F.lit(bytes([3, 1, 2, 0xFF]))))
    assert (r.pad, r.length, bytes(r.payload)) == (3, 258, b"\xff")


def test_write_blocks_sink_rejects(spark, tmp_path):
    from tessera.sources import tables as TB
    bad = spark.createDataFrame([(8, 1, b"\x01")], "pad int, length int, payload binary")
    with pytest.raises(Exception):
        TB.write_blocks(bad, str(tmp_path / "b"))
    good = spark.createDataFrame([(3, 258, b"\xff")], "pad int, length int, payload binary")
    TB.write_blocks(good, str(tmp_path / "g"))
    r = TB.read_blocks(spark, str(tmp_path / "g")).collect()[0]
    assert (r.pad_bits, r.n_symbols, bytes(r.payload_bytes)) == (3, 258, b"\xff")


def test_bytes_to_patches_wav(spark):
    files = spark.createDataFrame([(1, bytes(range(17)), "wav")], "id long, content binary, ext string")
    rows = P.to_patches(files, "id", "content", ext="ext").orderBy("patch_no").collect()
    assert [r.patch for r in rows] == [[119, 97, 118] + [256] * 13, list(range(16)), [16] + [256] * 15, [256] * 16]
    assert [r.mask for r in rows] == [1, 1, 1, 1]


def test_strip_padding(spark):
    assert one(spark, B.strip_padding(F.array(*[F.lit(x) for x in [1, 256, 2, 256, 256]]))) == [1, 256, 2]
    assert one(spark, B.strip_padding(F.array(*[F.lit(x) for x in [256, 256]]))) == []


def test_left_shift_mask(spark):
    df = spark.createDataFrame([([1, 1, 1, 0],)], "mask array<int>")
    out = df.select(TS.left_shift_mask("mask").alias("p"), TS.target_mask("mask").alias("t")).first()
    assert (out.p, out.t) == ([1, 1, 0, 0], [0, 1, 1, 0])


def test_normalize_pdf(spark):
    m = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5)], "a string, b string, p double")
    out = lm.normalize_pdf(m).collect()
    eps = float(np.finfo(np.float32).eps)
    for r in out:
        assert r.p_norm == pytest.approx(0.5 - eps, abs=1e-15)
    assert sum(r.p_norm for r in out) == pytest.approx(1 - 2 * eps, abs=1e-15)


def test_compression_ratio(spark):
    s = spark.createDataFrame([(50, 200), (0, 200)], "compressed_bytes long, original_bytes long")
    r = s.select(M.ratio(F.col("original_bytes"), F.col("compressed_bytes")).alias("ratio"),
                 M.rate(F.col("original_bytes"), F.col("compressed_bytes")).alias("rate")).collect()
    assert (r[0].ratio, r[0].rate) == (4.0, 0.25)
    assert (r[1].ratio, r[1].rate) == (0.0, 0.0)
    t = M.metric_totals(s.limit(1), extra_bytes=3, set_total_length=106).collect()[0]
    assert (t.ratio, t.rate) == (2.0, 0.5)


def test_split_tiles_geometry(spark):
    img = spark.createDataFrame([(1, 70, 40)], "id long, width int, height int")
    g = MD.tile_grid(img, "id", "width", "height").collect()
    assert len(g) == 6
    assert sorted({(r.col, r.w) for r in g}) == [(0, 32), (1, 32), (2, 6)]
    assert sorted({(r.row, r.h) for r in g}) == [(0, 32), (1, 8)]


def test_tiles_roundtrip(spark):
    px = bytes(np.random.default_rng(1).integers(0, 256, 70 * 40, dtype=np.uint8))
    img = spark.createDataFrame([(1, 70, 40, px)], "id long, width int, height int, pixels binary")
    merged = MD.merge_tiles(MD.split_tiles(img, "id", "width", "height", "pixels"), "id").collect()[0]
    assert (merged.width, merged.height, bytes(merged.pixels)) == (70, 40, px)


def test_split_audio_and_segment(spark):
    a = spark.createDataFrame([(1, bytes(20000))], "id long, pcm binary").select("id", MD.wav_blob("pcm").alias("wav"))
    chunks = MD.split_audio(a, "id", "wav").orderBy("chunk_no").collect()
    assert [len(c.frames) for c in chunks] == [8000, 8000, 4000]
    merged = MD.merge_audio(MD.split_audio(a, "id", "wav"), "id").collect()[0]
    assert bytes(merged.wav) == bytes(a.collect()[0].wav)
    seg = MD.audio_segment(a, "id", "wav", 2.0, 1.0).collect()[0]
    assert (seg.status, seg.start_ms, seg.end_ms, len(seg.frames)) == ("ok", 2000, 2500, 4000)
    assert MD.audio_segment(a, "id", "wav", 2.5, 1.0).collect()[0].status == "start_past_end"
    assert MD.audio_segment(a, "id", "wav", -1.0, 1.0).collect()[0].status == "negative_start"


def test_pairs(spark):
    f = TS.path_columns(spark.createDataFrame([("a.abc",), ("a.mid",), ("b.abc",)], "path string"))
    assert [tuple(r) for r in TS.pairs_unidirectional(f, "abc", "mid").collect()] == [("a.abc", "a.mid")]
    assert [tuple(r) for r in TS.pairs_bidirectional(f, "abc", "mid").collect()] == [("a.abc", "a.mid")] * 2


def test_path_columns(spark):
    r = TS.path_columns(spark.createDataFrame([("x/Business_1.txt",)], "path string")).collect()[0]
    assert (r.label, r.ext) == ("Business.txt", "txt")


def test_split_and_remainder(spark):
    files = spark.range(1000).select(F.col("id").cast("string").alias("path"))
    s = TS.train_eval_split(files, "path")
    assert s.filter("split = 'eval'").count() == 10 and s.count() == 1000
    r = TS.seeded_shuffle(spark.range(21).select(F.col("id").cast("string").alias("path")), "path")
    assert TS.drop_remainder(r, "shuffle_rank").count() == 16
    ranks = sorted(x.shuffle_rank for x in r.collect())
    assert ranks == list(range(21))


def test_best_epoch(spark):
    m = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, acc double")
    assert M.best_epoch(m, "epoch", "acc").collect()[0].best_epoch == 2


def test_opcode_name(spark):
    df = spark.createDataFrame([([13, 1, 2, 0],), ([11, 7, 0, 0],), ([0, 0, 0, 0],), ([99, 0, 0, 0],)], "ir array<int>")
    assert [r.x for r in df.select(P.opcode_name("ir").alias("x")).collect()] == ["ADD A B", "LOADI 7", "HLT", None]


def test_rag_context(spark):
    hits = spark.createDataFrame([(1, 2, "q"), (1, 1, "p"), (1, 3, "r")], "item_id long, rank int, chunk_text string")
    assert R.rag_context(hits).collect()[0].context == "p q r"


def test_knn_l2_is_2_minus_2ip(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, v[i].tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(100 + i, v[i].tolist()) for i in range(3)], "qid long, embedding array<double>")
    ip = {(r.qid, r.vec_id): r.score for r in R.knn_dense(q, corpus, k=50, metric="ip").collect()}
    l2 = {(r.qid, r.vec_id): r.score for r in R.knn_dense(q, corpus, k=50, metric="l2").collect()}
    for key, s in ip.items():
        assert l2[key] == pytest.approx(2 - 2 * s, abs=1e-5)


def test_verify_roundtrip_reports_first_difference(spark):
    a = spark.createDataFrame([(1, b"abcd"), (2, b"xyz")], "id long, data binary")
    b = spark.createDataFrame([(1, b"abXd"), (2, b"xyz")], "id long, data binary")
    rows = {r.id: r for r in P.verify_roundtrip(a, b, "id").collect()}
    assert (rows[1].equal, rows[1].first_diff) == (False, 3)
    assert (rows[2].equal, rows[2].first_diff) == (True, None)


@pytest.mark.parametrize("how,inclusive", [("sum", True), ("max", False), ("min", False)])
def test_running_agg_equals_one_window(spark, how, inclusive):
    # string keys, a third of the rows on one key: the tie column splits it
    rng = np.random.default_rng(7)
    keys = ["hot"] * 300 + [f"k{i:04d}" for i in rng.choice(5000, 600, replace=False)]
    vals = rng.integers(-50, 50, len(keys))
    df = spark.createDataFrame([(k, i, int(v) if i % 17 else None) for i, (k, v) in enumerate(zip(keys, vals))],
                               "k string, i long, v long").repartition(5)
    got = O.running_agg(df, ["k", "i"], ["v"], how, inclusive).select("i", "cum_v")
    frame = W.orderBy("k", "i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    want = df.select("i", fn("v").over(frame).alias("cum_v"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert O.in_order(df, ["k", "i"]).filter("k = 'hot'").select(O.PART).distinct().count() > 1


def test_ranks_stay_unique_with_all_columns(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    s = TS.seeded_shuffle(orders, "o_orderkey")
    s.write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    n = orders.count()
    r = s.agg(F.count_distinct("shuffle_rank"), F.min("shuffle_rank"), F.max("shuffle_rank"), F.count("*")).first()
    assert tuple(r) == (n, 0, n - 1, n) and set(s.columns) == {*orders.columns, "shuffle_rank"}


def test_chunk_ids_do_not_depend_on_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bounds = [0, 3, 50, 51, 120, 190, 10**9]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        docs.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "six"))
    six = spark.read.parquet(str(tmp_path / "six"))
    assert sorted(R.build_chunks(docs).collect()) == sorted(R.build_chunks(six).collect())


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_knn_dense_slices_and_blocks_equal_brute_force(spark, metric):
    # small integer vectors give many tied scores; ties go to the smaller corpus id
    rng = np.random.default_rng(3)
    cvec = rng.integers(-2, 3, (300, 4)).astype(float)
    qvec = rng.integers(-2, 3, (7, 4)).astype(float)
    corpus = spark.createDataFrame([(int(i) * 3 + 1, v.tolist()) for i, v in enumerate(cvec)],
                                   "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(int(i) + 100, v.tolist()) for i, v in enumerate(qvec)],
                                    "qid long, embedding array<double>")
    got = R.knn_dense(queries, corpus, k=5, metric=metric, block_bytes=120, score_cells=10).collect()
    got = sorted((r.qid, r.rank, r.vec_id, round(r.score, 6)) for r in got)
    want = []
    for qi, q in enumerate(qvec):
        s = cvec @ q if metric == "ip" else ((cvec - q) ** 2).sum(axis=1)
        key = -s if metric == "ip" else s
        order = sorted(range(len(cvec)), key=lambda i: (key[i], i * 3 + 1))[:5]
        want += [(qi + 100, r + 1, i * 3 + 1, round(float(s[i]), 6)) for r, i in enumerate(order)]
    assert got == sorted(want)


def test_sparse_knn_blocks_and_no_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    asked = bench.union(spark.createDataFrame([(900, "zzzzzz"), (901, ""), (902, None)], "item_id long, text string"))
    chunks = R.build_chunks(docs)
    a = R.knn_sparse(asked, chunks, k=3)
    b = R.knn_sparse(asked, chunks, k=3, block_bytes=3000)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.filter("item_id >= 900").count() == 0
    assert R.knn_sparse(asked.limit(0), chunks).collect() == []
    e = spark.createDataFrame([], "qid long, embedding array<double>")
    assert R.knn_dense(e, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect() == []


def test_document_bits_without_broadcast_equal_broadcast(spark, monkeypatch):
    from tessera.plans import hints
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm.train_bigram(docs)
    a = sorted(lm.document_bits(docs, model).collect())
    monkeypatch.setattr(hints, "estimated_bytes", lambda df: 1 << 60)
    b = sorted(lm.document_bits(docs, model).collect())
    assert [(r.doc_id, r.n_coded) for r in a] == [(r.doc_id, r.n_coded) for r in b]
    assert all(abs(x.bits - y.bits) < 1e-6 * max(1.0, x.bits) for x, y in zip(a, b))


def test_unseen_symbols_and_short_documents_are_scored(spark):
    train = spark.createDataFrame([(1, "abababab")], "doc_id long, text string")
    model = lm.train_bigram(train)                       # a->b 4, b->a 3, two successors
    docs = spark.createDataFrame([(1, "abzzab"), (2, "zzzz"), (3, "a"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_coded, r.bits) for r in lm.document_bits(docs, model).collect()}
    ab, b_new, z_new = -np.log2(5 / 6), np.log2(3 + 2), np.log2(2)
    assert got[1] == (5, pytest.approx(2 * ab + b_new + 2 * z_new))
    assert got[2] == (3, pytest.approx(3 * z_new))
    assert got[3] == got[4] == got[5] == (0, 0.0)
    t = {r.doc_id: (r.n_coded, r.n_in_topk) for r in lm.topk_membership(docs, model).collect()}
    assert t[1] == (5, 2) and t[2] == (3, 0) and t[5] == (0, 0)


def test_empty_payloads_come_back(spark):
    files = spark.createDataFrame([(1, b"", "wav"), (2, b"\x00ab", "wav")], "id long, content binary, ext string")
    back = {r.id: bytes(r.data) for r in P.merge_patches(P.to_patches(files, "id", "content", ext="ext"), "id").collect()}
    assert back == {1: b"", 2: b"\x00ab"}
    a = files.select("id", MD.wav_blob("content").alias("wav"))
    merged = {r.id: bytes(r.wav) for r in MD.merge_audio(MD.split_audio(a, "id", "wav"), "id").collect()}
    assert merged == {r.id: bytes(r.wav) for r in a.collect()}
    flat = spark.createDataFrame([(1, 70, 0, b""), (2, 0, 5, b"")], "id long, width int, height int, pixels binary")
    assert MD.split_tiles(flat, "id", "width", "height", "pixels").collect() == []


def test_wav_chunks_before_data(spark):
    pcm = bytes(range(200)) * 100
    plain = spark.createDataFrame([(1, pcm)], "id long, pcm binary").select(MD.wav_blob("pcm")).first()[0]
    plain = bytes(plain)
    listed = plain[:12] + b"LIST" + (5).to_bytes(4, "little") + b"INFOx\0" + plain[12:36] + b"fact" + (4).to_bytes(4, "little") + b"\0" * 4 + plain[36:]
    a = spark.createDataFrame([(1, plain), (2, listed), (3, b"RIFFxxxxWAVE"), (4, b"no")], "id long, wav binary")
    info = {r.id: (r.nchannels, r.sampwidth, r.framerate, r.nframes) for r in MD.wav_info(a, "id", "wav").collect()}
    assert info[1] == info[2] == (1, 1, 8000, 20000) and info[3][0] is None and info[4][0] is None
    merged = {r.id: bytes(r.wav) for r in MD.merge_audio(MD.split_audio(a, "id", "wav"), "id").collect()}
    assert merged == {1: plain, 2: plain}
    seg = {r.id: (r.status, r.frames and bytes(r.frames)) for r in MD.audio_segment(a, "id", "wav", 0.5, 1.0).collect()}
    assert seg[1] == seg[2] == ("ok", pcm[4000:12000]) and seg[3][0] == seg[4][0] == "not_wav"


def test_long_documents_are_split_into_blocks(spark, tmp_path):
    from tessera.operators import codec as C
    from tessera.sources import tables as TB
    docs = spark.createDataFrame([(1, b"x" * 70000), (2, b"")], "doc_id long, data binary")
    b = C.to_blocks(docs, "doc_id", "data", B.MAX_BLOCK_LENGTH).withColumnRenamed("data", "payload")
    TB.write_blocks(b.withColumn("pad", F.lit(0)).withColumn("length", F.octet_length("payload")), str(tmp_path / "b"))
    r = sorted((x.doc_id, x.block_no, x.n_symbols) for x in TB.read_blocks(spark, str(tmp_path / "b")).collect())
    assert r == [(1, 0, 65535), (1, 1, 4465), (2, 0, 0)]


def test_training_arrays(spark):
    rows = spark.createDataFrame([(0, list(range(16))), (1, list(range(48))), (2, [7] * 16)], "r long, s array<int>")
    got = sorted(TS.pad_batches(rows, "r", "s", 2).select(
        "r", "padded", "mask", TS.left_shift_mask("mask").alias("p"), TS.target_mask("mask").alias("t")).collect())
    assert got[0].padded == list(range(16)) + [256] * 32 and got[0].mask == [1, 0, 0] and got[0].p == [0, 0, 0]
    assert got[1].mask == [1, 1, 1] and got[1].p == [1, 1, 0] and got[1].t == [0, 1, 1]
    assert got[2].padded == [7] * 16 and got[2].mask == [1]
