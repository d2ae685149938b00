import corpus_pipeline as P
from tessera.llm import quality as Q
from tessera.llm.common import new_dir, prepare, read
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_tokens_and_files import check_packing

SF = "/root/testdata/sf0.001"


def stable(spark, df):
    path = new_dir(spark, "test")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]


def test_pipeline_equals_brute_force(spark):
    prepare(spark)
    docs = read(spark, SF, "documents")
    field = Q.fit(docs, read(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    share = dict(zip((d for d, _ in rows), field.content_share([t.encode() for _, t in rows])))
    rows = [(d, t) for d, t in rows if not ((c := brute_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]) and share[d] >= Q.MIN_CONTENT]
    fps = [(d, brute_fp(t)) for d, t in rows]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    rows = [r for r, c in zip(rows, comp) if r[0] == c]
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {d for d, _, n, _ in brute_hits(rows, items) if n}
    rows = [(d, t) for d, t in rows if d not in bad]
    clean = []
    for d, t in rows:
        out, last = [], 0
        for s, _, _, e in brute_secrets(t):
            if e > last:
                out += [t[last:s], "[secret]"] if s >= last else []
                last = e
        clean.append((d, "".join(out) + t[last:]))
    got = P.run(spark, SF).collect()
    check_packing(got, clean)
    assert 100 < len(clean) < 200


def test_stages_keep_columns_and_odd_rows(spark):
    prepare(spark)
    base = read(spark, SF, "documents")
    text = base.first().text
    odd = spark.createDataFrame([(None, None, "en", None, 0), (None, "", None, "s", 0), (7000, text, "en", "s", len(text)), (7000, text, "en", "s", len(text)), (None, text, "en", "s", 3)], base.schema)
    docs = stable(spark, base.union(odd))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, stable(spark, docs.limit(0)), SF).collect() == []
    kept = P.simhash_near_dedup(spark, docs, SF)
    assert kept.where(kept.text == text).count() == 1 and kept.where(kept.text == text).first().doc_id == base.first().doc_id
    assert P.secret_scan(spark, docs, SF).count() == docs.count()
    assert P.quality_rules(spark, docs, SF).where("text is null or text = ''").count() == 0
    assert P.sequence_packing(spark, docs, SF).count() >= docs.count()


def test_rows_dealt_anew_between_passes(spark):
    """Other file splits when the result is read than when the stage was called."""
    prepare(spark)
    path = new_dir(spark, "test")
    read(spark, SF, "documents").repartition(12, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for stage in (P.simhash_near_dedup, P.benchmark_decontamination):
        want = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
        out = stage(spark, docs, SF)
        old = {k: spark.conf.get(k) for k in keys}
        try:
            for k, v in zip(keys, ("8192", "1")):
                spark.conf.set(k, v)
            assert sorted(r.doc_id for r in out.collect()) == want
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
