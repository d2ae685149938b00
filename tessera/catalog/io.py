"""Registered source/sink queries: index store, appends, payloads, metric log, file scans.

Sinks write under the shared checkpoint folder and the query returns what was
read back, so the check covers the write and the read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import CHUNKS, words_sql
from tessera.operators import patches as P
from tessera.operators import retrieval as R
from tessera.session import scratch_path, stored, table
from tessera.sources import files as FS
from tessera.sources import pieces as PC
from tessera.sources import tables as TB


PIECE_PATCHES = 64       # small, so that pages have several pieces
READ_BYTES = 1500


def _scratch(spark, name):
    return scratch_path(spark, name)


@register("save_index", f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no, chunk_text FROM chunks")
def q_save_index(spark, sf):
    path = _scratch(spark, "index")
    TB.save_index(R.build_chunks(table(spark, sf, "documents")), path)
    return spark.read.parquet(path)


@register("load_or_build_index", f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no, chunk_text FROM chunks")
def q_load_or_build_index(spark, sf):
    path = _scratch(spark, "index")
    build = lambda: R.build_chunks(table(spark, sf, "documents"))
    TB.load_or_build_index(spark, path, build)            # builds
    return TB.load_or_build_index(spark, path, build)     # reuses the stored index


_APPEND_SQL = f"""{CHUNKS},
_bw AS (SELECT item_id, {words_sql("'Title: benchmark' || chr(10) || text")} AS w FROM benchmark),
_bc AS (SELECT item_id AS doc_id, CAST(i // 224 AS INTEGER) AS chunk_no, array_to_string(w[i + 1 : i + 256], ' ') AS chunk_text
        FROM (SELECT item_id, w, unnest(range(0, len(w), 224)) AS i FROM _bw)),
new_chunks AS (SELECT CAST((SELECT max(chunk_id) + 1 FROM chunks) + row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS BIGINT) AS chunk_id,
                      doc_id, chunk_no, chunk_text FROM _bc)"""


def _appended(spark, sf):
    path = _scratch(spark, "index")
    TB.save_index(R.build_chunks(table(spark, sf, "documents")), path)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("source"), "text")
    start = TB.append_index(spark, path, items)
    return spark.read.parquet(path), start


@register("append_index", f"WITH {_APPEND_SQL} SELECT chunk_id, doc_id, chunk_no, chunk_text FROM new_chunks")
def q_append_index(spark, sf):
    idx, start = _appended(spark, sf)
    return idx.filter(F.col("chunk_id") >= start).select("chunk_id", "doc_id", "chunk_no", "chunk_text")


@register("append_union", f"""WITH {_APPEND_SQL}
SELECT chunk_id, doc_id, chunk_no FROM chunks UNION ALL SELECT chunk_id, doc_id, chunk_no FROM new_chunks""")
def q_append_union(spark, sf):
    return _appended(spark, sf)[0].select("chunk_id", "doc_id", "chunk_no")


@register("write_payload", """
SELECT 'web/page_' || CAST(page_id AS VARCHAR) || '.html' AS path, CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes,
       md5(encode(html)) AS content_md5 FROM pages""")
def q_write_payload(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"))
    patches = P.to_patches(pages, "path", "content", ext_value="html")
    out = _scratch(spark, "payload")
    PC.write_pieces(P.patch_pieces(patches, "path", PIECE_PATCHES), out)
    back = PC.read_pieces(spark, out, piece_bytes=READ_BYTES).groupBy("path").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY piece_no)").alias("content"))
    return back.select("path", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("content_md5"))


@register("append_metrics_log", """
SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS epoch, round(avg(CAST(value > 10 AS INTEGER)), 4) AS acc,
       round(avg(value), 4) AS loss FROM events GROUP BY 1""")
def q_append_metrics_log(spark, sf):
    from tessera.catalog.metrics import _epochs
    ep = stored(_epochs(spark, sf), "epochs")
    out = _scratch(spark, "metrics_log")
    TB.append_metrics_log(ep.filter("epoch < 0"), out)             # the log starts empty
    TB.append_metrics_log(ep, out)
    return spark.read.parquet(out)


_NAMED_SQL = "SELECT md5(text) AS content_md5, CAST(octet_length(encode(text)) AS BIGINT) AS length"


def _document_files(spark, sf, name, separator="/"):
    """Documents written as one text file each: <lang>/<source>_<doc_id>.txt."""
    out = _scratch(spark, name)
    docs = table(spark, sf, "documents")
    named = docs.select(F.concat("lang", F.lit(separator), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
                        F.encode("text", "UTF-8").alias("content"))
    FS.write_files(named, out, "name", "content").write.format("noop").mode("overwrite").save()
    return out


@register("scan_text_files", "SELECT lang, doc_id, md5(text) AS content_md5, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def q_scan_text_files(spark, sf):
    t = FS.read_text_files(spark, _document_files(spark, sf, "text_files"), glob="*.txt")
    return t.select(F.element_at(F.split("path", "/"), -2).alias("lang"),
                    F.regexp_extract("path", r"_(\d+)\.txt$", 1).cast("long").alias("doc_id"),
                    F.md5("text").alias("content_md5"), F.length("text").alias("n_chars"))


@register("scan_binary_glob", f"""{_NAMED_SQL}, lang || '-' || source || '.txt' AS label, 'txt' AS ext FROM documents""")
def q_scan_binary_glob(spark, sf):
    f = FS.read_binary_files(spark, _document_files(spark, sf, "binary_files", "-"), glob="*.txt", recursive=False)
    return f.select(F.md5("content").alias("content_md5"), "length", F.substring_index("label", "/", -1).alias("label"), "ext")


@register("scan_recursive", f"{_NAMED_SQL}, doc_id FROM documents")
def q_scan_recursive(spark, sf):
    f = FS.read_binary_files(spark, _document_files(spark, sf, "tree"), recursive=True, ext_regex=FS.ext_filter(["TXT"]))
    return f.select(F.md5("content").alias("content_md5"), "length", F.regexp_extract("path", r"_(\d+)\.txt$", 1).cast("long").alias("doc_id"))
