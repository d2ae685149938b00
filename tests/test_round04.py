"""What was left open in round 3: steps that scale, with the results of a plain computation."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import backoff as BO
from tessera.operators import lm
from tessera.operators import retrieval as R


def windows(rows, order):
    return Counter((i, t[max(0, j - order):j], t[j]) for i, t in rows for j in range(1, len(t or "")))


def test_character_windows_are_counted_where_texts_are_read(spark, monkeypatch):
    """counts of every row, repeated and null ids included, with no exchange before the price."""
    rows = [(1, "abcabca"), (2, ""), (3, None), (None, "é漢\U0001f600漢é"), (5, "x"), (1, "ab"), (6, "ab" * 50)]
    df = spark.createDataFrame(rows, "id long, text string")
    for chars in (1 << 19, 3):
        monkeypatch.setattr(lm, "SLICE_CHARS", chars)
        for order in (1, 3):
            plan = lm.window_counts(df, ["id"], "text", order)
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
            got = Counter()
            for r in plan.collect():
                got[r.id, r.ctx, r.sym] += r.n
            assert got == windows(rows, order)
            pooled = Counter()
            for r in lm.window_counts(df, [], "text", order).collect():
                pooled[None, r.ctx, r.sym] += r.n
            assert pooled == windows([(None, t) for _, t in rows], order)
    bits = lm.document_bits(df, lm.train_bigram(df), "id")
    assert "Generate" not in bits._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.n_coded for r in bits.collect()} == {1: 7, 2: 0, 3: 0, None: 0, 5: 0, 6: 99}
    scored = BO.document_bits(df, BO.train(df, min_count=1), "id").collect()
    assert {r.id: r.n_coded for r in scored} == {1: 7, 2: 0, 3: 0, None: 0, 5: 0, 6: 99}


def test_windows_of_many_characters():
    """keys of windows are numbered anew before they outgrow 64 bits."""
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 200))) for _ in range(20)]
    for order in (1, 6):
        row, ctx, sym, n = lm._windows("".join(texts), np.array([200] * 20), order, True)
        assert Counter(dict(zip(zip(row.tolist(), ctx.to_pylist(), sym.to_pylist()), n.tolist()))) == windows(enumerate(texts), order)


def test_words_of_a_batch(spark):
    """Words split in Arrow batches are those of ``T.words``, for every kind of white space."""
    rows = [(i, t) for i, t in enumerate(["a b", " a  b ", "", " \t\x1c\x1f", None, *(f"x{chr(c)}y{chr(c)}" for c in [*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF])])]
    df = spark.createDataFrame(rows, "cid long, text string")
    want = {r.cid: r.w or [] for r in df.select("cid", T.words("text").alias("w")).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["cid", "text"])
    out = next(R.split_words([batch])).to_pydict()
    assert {i: w or [] for i, w in zip(out["cid"], out["words"])} == want


def test_documents_are_chunked_once(spark, monkeypatch):
    """Putting chunks in order reads stored rows; the words are split in one job."""
    seen = []
    plain = R.assign_consecutive_ids
    monkeypatch.setattr(R, "assign_consecutive_ids", lambda df, *a, **k: (seen.append(df), plain(df, *a, **k))[1])
    docs = spark.createDataFrame([(i, "s", f"w{i} " * 600) for i in range(5)], "doc_id long, source string, text string")
    ids = [r.chunk_id for r in R.build_chunks(docs).orderBy("doc_id", "chunk_no").collect()]
    assert ids == list(range(len(ids))) and len(ids) == 15
    assert "Generate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_byte_features_are_those_of_the_spark_ml_stages(spark):
    """NGram and HashingTF give the same vectors; the payloads are read once, for training and prediction."""
    from pyspark.ml.feature import HashingTF, NGram
    from pyspark.ml.linalg import SparseVector

    from tessera.operators import classify as CL

    rng = np.random.default_rng(4)
    rows = [(i, bytes(rng.integers(0, 256, n).astype(np.uint8))) for i, n in enumerate([0, 1, 2, 3, 700, 70000])] + [(9, None), (9, b"ab")]
    df = spark.createDataFrame(rows, "id long, content binary")
    for n in (1, 2, 3):
        hexed = df.select("id", F.regexp_extract_all(F.hex(F.coalesce("content", F.lit(b"").cast("binary"))), F.lit("([0-9A-F]{2})"), 1).alias("b"))
        want = HashingTF(numFeatures=CL.NUM_FEATURES, inputCol="g", outputCol="_tf").transform(NGram(n=n, inputCol="b", outputCol="g").transform(hexed))
        got = CL.byte_features(df, "content", n)
        read = lambda d: sorted((r.id, r._tf.indices.tolist(), r._tf.values.tolist()) for r in d.select("id", "_tf").collect())
        assert isinstance(got.first()._tf, SparseVector) and read(got) == read(want)
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_postings_cross_the_shuffle_once(spark):
    """F8: the sums of an index search meet by row before they are spread over the queries; the hits are those of the scan."""
    from tessera.operators import inverted as I

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{int(rng.zipf(1.4)) % 200}" for _ in range(n))
    rows = [(i, text(int(rng.integers(1, 40)))) for i in range(200)] + [(900, ""), (901, None), (902, " \t")]
    corpus = spark.createDataFrame(rows, "chunk_id long, chunk_text string")
    queries = spark.createDataFrame([(i, text(6)) for i in range(12)] + [(50, "unheard"), (51, None)], "item_id long, text string")
    index = I.build(corpus)
    norm = {r.cid: sum(t.weight ** 2 for t in r.terms) for r in index.vectors.collect()}
    assert set(norm) == set(range(200)) and all(abs(x - 1) < 1e-9 for x in norm.values())
    plan = I.candidates(I.query_terms(queries, index, "item_id", "text"), index, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cid") == 1 and not re.search(r"hashpartitioning\(qid#\d+L?, cid", plan)
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(I.knn(queries, index, 3)[0]) == rows_of(R.knn_sparse(queries, corpus, 3))
