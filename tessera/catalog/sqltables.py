"""Registered queries written in SQL alone, with the table functions."""

from __future__ import annotations

from tessera.catalog import register
from tessera.catalog.bytes import PAGES, _TRACE_SQL
from tessera.catalog.sqlparts import CHUNKS
from tessera.functions.sqltables import register as define
from tessera.functions.text import CHUNK_OVERLAP, CHUNK_SIZE
from tessera.session import table


@register("chunks_table_function", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_text FROM chunks")
def q_chunks_table_function(spark, sf):
    define(spark)
    return spark.sql(f"""SELECT d.doc_id, c.chunk_no, c.chunk_text
FROM {{docs}} d, LATERAL chunks_of(concat('Title: ', d.source, chr(10), d.text), {CHUNK_SIZE}, {CHUNK_OVERLAP}) c""", docs=table(spark, sf, "documents"))


@register("patches_table_function", f"""WITH {PAGES},
_p AS (SELECT page_id, h, unnest(range(1, m + 1)) AS patch_no FROM _pn)
SELECT page_id, CAST(patch_no AS INTEGER) AS patch_no, unhex(substr(h, (patch_no - 1) * 32 + 1, 32)) AS patch FROM _p""")
def q_patches_table_function(spark, sf):
    define(spark)
    return spark.sql("SELECT p.page_id, c.patch_no, c.patch FROM {pages} p, LATERAL patches_of(encode(p.html, 'UTF-8')) c", pages=table(spark, sf, "pages"))


@register("records_table_function", f"""WITH {_TRACE_SQL}
SELECT page_id, step, r[1] AS pc, r[2] AS acc, r[3:6] AS ir, r[7:16] AS registers FROM _rec""")
def q_records_table_function(spark, sf):
    define(spark)
    return spark.sql("SELECT p.page_id, c.* FROM {pages} p, LATERAL records_of(encode(p.html, 'UTF-8')) c", pages=table(spark, sf, "pages"))
