"""One registered query per operator, over its whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (binary_output, decontam, ego_join, licenses, merkle, packing, pitman_yor, quality, secrets, simhash, spelling,
                         suffix_dedup, warc)
from tessera.llm.common import new_dir, prepare, read
from tessera.llm.oracles import EGO_SQL, MERKLE_SQL, SPELLING_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn, sql: str | None = None):
    if isinstance(fn, str):
        return functools.partial(query, sql=fn)

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    if sql is not None:
        ORACLE[fn.__name__] = sql
    return fn


@query
def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_versions(docs, new_dir(spark, "secret-ledger"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE.rules))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query
def op10_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, field).select("doc_id", "quality_rules.*")


@query
def op4_benchmark_decontamination(spark, sf_dir):
    found = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("row").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


@query
def op6_sequence_packing(spark, sf_dir):
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


@query
def op7_binary_records(spark, sf_dir):
    return binary_output.round_trip(read(spark, sf_dir, "documents"))


@query
def op5_warc_salvage(spark, sf_dir):
    folder = new_dir(spark, "warc")
    manifest = warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder).where("kind = 'record'").select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), warc.page_number("refers_to").alias("refers_to"))


@query
def op8_license_scan(spark, sf_dir):
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query
def op3_lm_scoring(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pitman_yor.score(docs, held_out=pitman_yor.held_out_by_id())


@query
def op9_suffix_array_dedup(spark, sf_dir):
    found = suffix_dedup.remove(read(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256")


@query(SPELLING_SQL)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "word", "form", "root", "n", "n_near", "form_n")


@query(MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(read(spark, sf_dir, "documents"), tampered=F.when(hit, merkle.lowered(text)).otherwise(text))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("steps").alias("proof_sha256"),
                       merkle.folded(F.col("seen"), "steps").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(EGO_SQL)
def op13_embedding_near_dedup(spark, sf_dir):
    return ego_join.near_duplicates(read(spark, sf_dir, "embeddings"))
