"""The variable-order model, coding driven by predictors, models per kind, the classifier by counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import backoff as BO
from tessera.operators import classify as CL
from tessera.operators import codec as C
from tessera.operators import keyed as K
from tessera.operators import lm
from tessera.operators import predictive as PR
from tessera.session import scratch_path, table

SF = "/root/testdata/sf0.001"


def test_distributions_sum_to_one(spark):
    m = BO.train(table(spark, SF, "documents"), order=2, min_count=20)
    symbols = [r.sym for r in m.entries.where("level = 0").collect()]
    contexts = ["", "e", "th", "q~", "~~", "~"]
    seen = spark.createDataFrame([(c, s) for c in contexts for s in [*symbols, "☃"]], "ctx string, sym string")
    total = {r.ctx: r.p for r in BO.price(seen, m).groupBy("ctx").agg(F.sum("p").alias("p")).collect()}
    assert all(abs(p - 1) < 1e-9 for p in total.values()) and len(total) == len(contexts)


def test_contexts_are_closed_under_suffixes(spark):
    m = BO.train(table(spark, SF, "documents"))
    kept = {r.ctx for r in m.contexts.collect()}
    assert len(kept) > 500 and all(c[1:] in kept for c in kept)


def test_fewer_bits_than_pairs_on_unseen_turns(spark):
    docs = table(spark, SF, "documents")
    turns = table(spark, SF, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    path = scratch_path(spark, "test-model")
    BO.save(BO.train(docs), path)
    long = BO.document_bits(turns, BO.load(spark, path), id_col="turn_id").agg(F.sum("bits")).first()[0]
    short = lm.document_bits(turns, lm.train_bigram(docs), id_col="turn_id").agg(F.sum("bits")).first()[0]
    assert long < 0.95 * short
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "☃☃")], "doc_id long, text string")
    got = {r.doc_id: (r.n_coded, r.bits) for r in BO.document_bits(odd, BO.load(spark, path)).collect()}
    assert got[1] == got[2] == got[3] == (0, 0.0) and got[4][0] == 1 and got[4][1] > 8


PAYLOADS = [b"", b"a", bytes(range(256)) * 20, "häé ☃".encode() * 300, b"\x00" * 5000, b"the end of the text " * 200]


def coded_with(spark, factory, name, n=40):
    data = spark.createDataFrame([(i, bytearray(PAYLOADS[i % 6])) for i in range(n)], "doc_id long, data binary").repartition(3)
    blocks = C.to_blocks(data, "doc_id", "data", 700)
    path = scratch_path(spark, "test-coded")
    PR.compress_predicted(blocks, factory, name).write.parquet(path)
    return spark.read.parquet(path)


def test_predicted_round_trip(spark):
    data = spark.createDataFrame([(bytearray(p),) for p in PAYLOADS], "data binary")
    factory, name = PR.order_two(spark, PR.save_order_two(data))
    coded = coded_with(spark, factory, name)
    back = C.merge_blocks(PR.decompress_predicted(coded.repartition(2), factory, name), "doc_id").collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {i: PAYLOADS[i % 6] for i in range(40)}
    size = coded.agg(F.sum(F.octet_length("payload"))).first()[0]
    assert size < 0.2 * sum(len(PAYLOADS[i % 6]) for i in range(40))


def test_finite_predictors_are_asked_for_rows_only(spark):
    """The same payloads whether a predictor gives rows or whole distributions, each row made into frequencies once."""
    data = spark.createDataFrame([(bytearray(p),) for p in PAYLOADS], "data binary")
    order_two, _ = PR.order_two(spark, PR.save_order_two(data))

    class RowsOnly(PR.OrderTwo):
        def __init__(self):
            self.__dict__ = order_two().__dict__

        def __call__(self, seen):
            raise AssertionError("a whole distribution was asked for")

    def whole():
        p = order_two()
        return lambda seen: p(seen)

    seqs = [PAYLOADS[i % 6][i:] for i in range(20)]
    rows, full = PR._Asked(RowsOnly()), PR._Asked(whole())
    coded = C.encode_lanes(seqs, PR._Writing(rows, seqs))
    assert coded == C.encode_lanes(seqs, PR._Writing(full, seqs))
    sizes = [len(s) for s in seqs]
    for ask in (rows, full):
        assert C.decode_lanes(coded, sizes, PR._Reading(ask, len(seqs), max(sizes))) == seqs


def test_any_predictor_plugs_in(spark):
    def repeats():              # the next byte is likely the byte before
        def predict(seen):
            p = np.full((len(seen), 256), 0.1 / 255)
            p[np.arange(len(seen)), seen[:, -1] if seen.shape[1] else 0] = 0.9
            return p
        return predict

    coded = coded_with(spark, repeats, "repeats", 12)
    back = C.merge_blocks(PR.decompress_predicted(coded, repeats, "repeats"), "doc_id").collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {i: PAYLOADS[i % 6] for i in range(12)}
    flat = lambda: lambda seen: np.full((len(seen), 256), 1 / 256)
    with pytest.raises(Exception, match="not other"):
        PR.decompress_predicted(coded, repeats, "other").collect()
    with pytest.raises(Exception, match="other distributions"):
        PR.decompress_predicted(coded, flat, "repeats").collect()


def test_models_by_kind(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "txt", bytearray(b"abab" * (i % 9) + b"x")) for i in range(30)] + [(100 + i, "bin", bytearray(rng.bytes(i * 7))) for i in range(30)]
    pieces = spark.createDataFrame(rows, "id long, kind string, data binary")
    path = scratch_path(spark, "test-models")
    K.count_symbols(pieces).write.parquet(path)
    models = K.load_models(spark, path)
    coded = K.compress_pieces(pieces, models, ["id"])
    assert {r.id: bytes(r.data) for r in K.decompress_pieces(coded, models, ["id"]).collect()} == {i: bytes(d) for i, _, d in rows}
    assert all(r.n_symbols % 16 == 0 for r in coded.collect())
    other = coded.withColumn("kind", F.lit("txt"))
    with pytest.raises(Exception, match="another model"):
        K.decompress_pieces(other, models, ["id"]).collect()


def test_counting_classifier(spark):
    rows = [(i, "ab"[i % 2], (("xyxy" if i % 2 else "zzzw") * 5).encode()) for i in range(20)]
    train = spark.createDataFrame([(i, l, bytearray(c)) for i, l, c in rows], "id long, label string, content binary")
    odd = train.unionByName(spark.createDataFrame([(50, None, None), (51, None, bytearray(b"q")), (52, None, bytearray(b"zzz"))], train.schema))
    m = CL.fit_counts(odd, "content", "label")
    got = {r.id: r.predicted for r in CL.predict_counts(m, odd, "id", "content").collect()}
    assert all(got[i] == l for i, l, _ in rows) and got[50] == "a" and got[52] == "a" and len(got) == 23
    score = math.log(10 / 20) + 2 * math.log(101) - 2 * math.log(190 + 65536)     # "zz" was seen 100 times among 190 pairs of a
    assert score < 0
