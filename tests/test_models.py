"""Model hooks, generation and the byte classifier."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import hooks as H
from tessera.operators import lm
from tessera.operators.generate import generate

SF = "/root/testdata/sf0.001"


def test_embed_udf_unit_vectors(spark):
    df = spark.createDataFrame([(1, "the cat the"), (2, "")], "id long, text string")
    rows = {r.id: r.v for r in df.select("id", H.embed_udf()("text").alias("v")).collect()}
    v = np.array(rows[1])
    assert v.shape == (H.EMBED_DIM,) and abs(np.linalg.norm(v) - 1) < 1e-12
    assert sorted(np.round(v[v > 0] ** 2 * 5, 6)) == [1.0, 4.0]     # tf 1 and 2 over norm sqrt(5)
    assert not np.any(rows[2])


def test_predictor_hook_equals_join_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train_bigram(docs)
    default = {r.doc_id: r.bits for r in H.predict_symbols(docs, model).groupBy("doc_id").agg(F.sum(-F.log2("p")).alias("bits")).collect()}
    join = {r.doc_id: r.bits for r in lm.document_bits(docs, model).collect()}
    assert all(abs(default[d] - b) < 1e-6 * b for d, b in join.items())
    plugged = H.predict_symbols(docs, predictor_factory=lambda: lambda texts: [[0.25] * max(len(t) - 1, 0) for t in texts])
    per = {r.doc_id: (r.n, r.bits) for r in plugged.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(-F.log2("p")).alias("bits")).collect()}
    assert all(per[r.doc_id] == (r.n_coded, 2.0 * r.n_coded) for r in lm.document_bits(docs, model).collect() if r.n_coded)


def test_default_encoder_equals_the_hook(spark):
    df = spark.createDataFrame([(1, "the cat the"), (2, ""), (3, "Ünï cat"), (4, None)], "id long, text string")
    jvm = {r.id: r.embedding for r in H.hashed_embedding(df, "id", "text").collect()}
    hook = {r.id: r.v for r in df.select("id", H.embed_udf()("text").alias("v")).collect()}
    assert jvm.keys() == hook.keys() and all(np.allclose(jvm[i], hook[i]) for i in jvm)


def test_generation_is_deterministic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train_bigram(docs)
    prompts = spark.createDataFrame([(1, "Th"), (2, "Le")], "id long, prompt string")
    a = sorted(map(tuple, generate(prompts, model, max_new=20).collect()))
    b = sorted(map(tuple, generate(prompts.repartition(2), model, max_new=20).collect()))
    assert a == b
    assert all(r[3] <= 20 for r in a)


def test_classifier_beats_chance(spark):
    import __spark_entry__ as E
    res = {r.split: r.accuracy for r in E.queries()["classify_bytes"](spark, SF).collect()}
    assert res["eval"] > 0.5      # four languages: chance is about 0.25
