"""Registered scans, projections, text guards and hashing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import words_sql
from tessera.functions import text as T
from tessera.session import table

TAKE_N = 100   # number of documents a compression run takes


@register("scan_documents", """
SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n_chars, CAST(sum(length(text)) OVER () AS BIGINT) AS total_chars FROM documents""")
def q_scan_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    total = d.select(F.sum(F.length("text"))).scalar()
    return d.select("doc_id", "text", F.length("text").alias("n_chars"), total.cast("long").alias("total_chars"))


@register("prune_columns", "SELECT doc_id, text FROM documents")
def q_prune_columns(spark, sf):
    return table(spark, sf, "documents").drop("lang", "source", "n_chars")


@register("take_n", f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {TAKE_N}")
def q_take_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").limit(TAKE_N)


@register("guard_text", r"""
SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f]') THEN 'empty' WHEN length(text) > 50000 THEN 'too_long' ELSE 'ok' END AS status
FROM documents
UNION ALL
SELECT 1000000000 + conv_id * 1000 + turn AS doc_id,
       CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f]') THEN 'empty' WHEN length(text) > 50000 THEN 'too_long' ELSE 'ok' END AS status
FROM conversations""")
def q_guard_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.guard_status("text").alias("status"))
    c = table(spark, sf, "conversations").select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.guard_status("text").alias("status"))
    return d.unionByName(c)


@register("truncate_text", """
SELECT page_id, substring(html, 1, 50000) AS text, CAST(length(substring(html, 1, 50000)) AS INTEGER) AS n_chars FROM pages""")
def q_truncate_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.truncate("html").alias("text"))
    return p.withColumn("n_chars", F.length("text"))


@register("preview_text", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents""")
def q_preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"))


@register("tokenize", f"""
SELECT doc_id, CAST(len({words_sql("text")}) AS INTEGER) AS n_words, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM documents""")
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.words("text")).alias("n_words"), F.length("text").alias("n_chars"),
                    F.octet_length("text").alias("n_bytes"))


@register("utf8_roundtrip", """
SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes, true AS valid_utf8, true AS roundtrip_equal FROM pages""")
def q_utf8_roundtrip(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html", T.utf8_bytes("html").alias("b"))
    return p.select("page_id", F.octet_length("b").alias("n_bytes"),
                    F.is_valid_utf8(F.col("b").cast("string")).alias("valid_utf8"),
                    (F.decode("b", "UTF-8") == F.col("html")).alias("roundtrip_equal"))


@register("content_hash", """
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id""")
def q_content_hash(spark, sf):
    c = table(spark, sf, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n")).alias("content_md5"))


@register("dedupe_by_hash", """
SELECT max(doc_id) AS doc_id, md5(text) AS content_md5, count(*) AS n_copies FROM documents GROUP BY md5(text)""")
def q_dedupe_by_hash(spark, sf):
    # Later write wins: the largest id of each content hash is kept. Partial
    # aggregation combines a hot hash map-side, so one text copied a billion
    # times still costs one row per partition in the shuffle.
    d = table(spark, sf, "documents")
    return d.groupBy(F.md5("text").alias("content_md5")).agg(
        F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
