"""Columns of the input that carry the names the operators use themselves, and hot ids."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, quality, secrets
from tessera.llm.common import Blocks, Kept, new_dir, prepare, read

SF = "/root/testdata/sf0.001"
NAMES = ["quality_rules", "_quality_rules", "row", "_row", "__row", "__spans", "spans", "__blob", "blob", "license", "number", "grp", "fp", "group",
         "component_id", "first", "items", "__text", "__id", "id", "kept", "pack", "ROW"]


def with_clashes(docs, names=NAMES):
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names if n != "ROW"])


def stable(spark, df):
    path = new_dir(spark, "test")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_values_of_any_name(spark, k):
    prepare(spark)
    docs = read(spark, SF, "documents")
    wide = stable(spark, with_clashes(docs))
    stage = P.STAGES[k][1]
    got = stage(spark, wide, SF)
    assert got.columns == wide.columns
    rows = got.collect()
    want = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert all(r[n] == f"{n}-{r.doc_id}" for n in NAMES if n != "ROW")


def test_packing_takes_any_columns(spark):
    wide = stable(spark, with_clashes(read(spark, SF, "documents").limit(20)))
    assert P.sequence_packing(spark, wide, SF).count() >= 20


def test_license_column_is_replaced(spark):
    docs = read(spark, SF, "documents").limit(30)
    plain = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    got = licenses.scan(docs.withColumn("license", F.lit("mine")).withColumn("text2", F.lit(1))).collect()
    assert {r.doc_id: r.license for r in got} == plain and got[0].text2 == 1
    mine = licenses.scan(docs.withColumn("license", F.lit("mine")), out_col="found").first()
    assert mine.license == "mine" and mine.found.n_words is not None


def with_secrets(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    leak = F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.lit(" password: hunter2hunter2 end"))).otherwise(F.col("text"))
    return stable(spark, docs.withColumn("text", leak))


def test_redaction_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = with_secrets(spark)
    ledger = new_dir(spark, "ledger")
    secrets.update_ledger(docs.select("text"), ledger)
    want = {r.doc_id: r.text for r in secrets.redact(docs, ledger).collect()}
    assert any("[secret]" in t for t in want.values())
    monkeypatch.setattr(secrets, "bounded_broadcast", lambda df: df)
    assert {r.doc_id: r.text for r in secrets.redact(docs, ledger).collect()} == want


def test_clean_texts_are_not_shuffled(spark):
    docs = with_secrets(spark)
    ledger = new_dir(spark, "ledger")
    secrets.update_ledger(docs.select("text"), ledger)
    plan = secrets.redact(docs, ledger)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("LeftOuter") == 0


def test_one_labelled_id_on_a_third_of_the_rows(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    labels = read(spark, SF, "labels")
    hot = labels.orderBy("doc_id").first().doc_id
    many = docs.union(docs.where(F.col("doc_id") == hot).select("doc_id", F.explode(F.array_repeat("text", 3000))))
    a, b = quality.fit(docs, labels), quality.fit(many, labels)
    assert (a.weights == b.weights).all() and (a.change == b.change).all()


def test_missing_rows_of_a_block_are_an_error(spark):
    import os

    df = spark.range(40).selectExpr("id % 4 as block", "id as v")
    kept = Kept(df, "test-kept")
    blocks = Blocks(spark.createDataFrame([(i, bytearray(b"x" * 10)) for i in range(4)], "id long, text binary").repartition(1), "test-blocks", 10)
    assert blocks.count == 4

    def run(dealt):
        import pyarrow as pa
        for number, cols, table in dealt:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([table.num_rows if table else 0])], names=["number", "n"])

    assert sorted(r.n for r in blocks.map(run, "number long, n long", (kept,)).collect()) == [10] * 4
    folder = kept.folder.removeprefix("file:") + "/block=2"
    for f in os.listdir(folder):
        os.remove(f"{folder}/{f}")
    with pytest.raises(Exception, match="rows"):
        blocks.map(run, "number long, n long", (kept,)).collect()
