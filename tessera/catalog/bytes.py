"""Registered byte-level queries: patches, padding, truncation, merge, bits, blocks, traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.sqlparts import MODEL
from tessera.functions import bytes as B
from tessera.operators import lm
from tessera.operators import patches as P
from tessera.operators import trainset as TS
from tessera.operators.ordering import global_rank
from tessera.session import table

PAGE_EXT = "html"
BATCH = 8
SEED = 31


def ints_sql(h: str) -> str:
    """DuckDB: list of byte values from a hex string expression."""
    return f"list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::INTEGER)"


def pad16_sql(v: str) -> str:
    return f"list_concat({v}, list_transform(range(16 - len({v})), lambda x: 256))"


PAGES = """
_pb AS (SELECT page_id, encode(html) AS b, hex(encode(html)) AS h FROM pages),
_pn AS (SELECT page_id, b, h, CAST(ceil(octet_length(b) / 16) AS INTEGER) AS m FROM _pb)"""


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))


def _patches(spark, sf):
    return P.to_patches(_pages(spark, sf), "page_id", "content", ext_value=PAGE_EXT)


@register("bytes_to_patches", f"""WITH {PAGES},
_p AS (SELECT page_id, h, m, unnest(range(0, m + 2)) AS patch_no FROM _pn)
SELECT page_id, CAST(patch_no AS INTEGER) AS patch_no,
  CASE WHEN patch_no = 0 THEN {pad16_sql(ints_sql("hex(encode('" + PAGE_EXT + "'))"))}
       WHEN patch_no = m + 1 THEN {pad16_sql("[]::INTEGER[]")}
       ELSE {pad16_sql(ints_sql("substr(h, (patch_no - 1) * 32 + 1, 32)"))} END AS patch,
  1 AS mask
FROM _p""")
def q_bytes_to_patches(spark, sf):
    return _patches(spark, sf)


@register("verify_roundtrip", f"""WITH {PAGES}
SELECT page_id, true AS equal, CAST(octet_length(b) AS INTEGER) AS original_bytes,
       CAST(octet_length(b) AS INTEGER) AS rebuilt_bytes, CAST(NULL AS INTEGER) AS first_diff FROM _pn""")
def q_verify_roundtrip(spark, sf):
    pages = _pages(spark, sf)
    rebuilt = P.merge_patches(P.to_patches(pages, "page_id", "content", ext_value=PAGE_EXT), "page_id")
    return P.verify_roundtrip(pages.withColumnRenamed("content", "data"), rebuilt, "page_id")


@register("strip_padding", f"""WITH {PAGES}
SELECT page_id, CAST(octet_length(b) AS INTEGER) AS n_bytes,
       CAST(16 * m AS INTEGER) AS padded_len, md5(b) AS content_md5 FROM _pn""")
def q_strip_padding(spark, sf):
    p = _patches(spark, sf)
    flat = p.filter(F.col("patch_no") > 0).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("patch_no", "patch"))).alias("s"))
    data = F.flatten(F.transform(F.slice("s", 1, F.size("s") - 1), lambda s: s["patch"]))     # without the end patch
    flat = flat.select("page_id", data.alias("a"))
    return flat.select("page_id", F.size(B.strip_padding("a")).alias("n_bytes"), F.size("a").alias("padded_len"),
                       F.md5(B.from_ints(B.strip_padding("a"))).alias("content_md5"))


@register("ordered_merge", """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_pieces, string_agg(text, chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id""")
def q_ordered_merge(spark, sf):
    c = table(spark, sf, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_pieces"),
                                    F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("merged"))


def _windows(spark, sf):
    """(page_id, row, patches): each page's flat patch array cut to its training window, with its rank."""
    cut = TS.truncate_windows(_patches(spark, sf), "page_id")
    arrays = TS.file_patch_arrays(cut, "page_id")
    ranks = global_rank(table(spark, sf, "pages").select("page_id"), ["page_id"], out="row")
    return arrays.join(ranks, "page_id").select("page_id", "row", F.flatten("patches").alias("symbols"))


# Symbols of a page as a list of byte values, 256 for padding: extension patch, data patches, end patch;
# cut to its window of at most 1024 patches.
_SYMBOLS_SQL = f"""{PAGES},
_t AS (SELECT page_id, h, m, m + 2 AS n_patches,
              ('0x' || substr(md5('{SEED}:trunc:' || CAST(page_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS c,
              ('0x' || substr(md5('{SEED}:trunc:' || CAST(page_id AS VARCHAR)), 9, 8))::BIGINT AS u FROM _pn),
_c AS (SELECT *, CASE WHEN n_patches <= 1024 THEN 'whole' WHEN c = 0 THEN 'head'
                      WHEN c = 1 AND n_patches > 1025 THEN 'body' ELSE 'tail' END AS choice FROM _t),
_w AS (SELECT page_id, choice, n_patches, CAST(CASE choice WHEN 'body' THEN 1 + u % (n_patches - 1024) WHEN 'tail' THEN n_patches - 1024 ELSE 0 END AS INTEGER) AS start_patch,
              list_concat(list_concat({pad16_sql(ints_sql("hex(encode('" + PAGE_EXT + "'))"))}, {ints_sql("h")}),
                          list_transform(range(m * 16 - length(h) // 2 + 16), lambda x: 256)) AS s FROM _c),
sym AS (SELECT page_id, choice, n_patches, start_patch, CAST(least(n_patches, 1024) AS INTEGER) AS kept_patches,
               s[start_patch * 16 + 1 : (start_patch + least(n_patches, 1024)) * 16] AS symbols,
               CAST((row_number() OVER (ORDER BY page_id) - 1) // {BATCH} AS INTEGER) AS batch_no FROM _w)"""


def _md5_of(symbols):
    return F.md5(F.array_join(symbols, ","))


@register("truncate_window", f"""WITH {_SYMBOLS_SQL}
SELECT page_id, n_patches, choice, start_patch, kept_patches, md5(array_to_string(symbols, ',')) AS symbols_md5 FROM sym""")
def q_truncate_window(spark, sf):
    cut = TS.truncate_windows(_patches(spark, sf), "page_id")
    a = TS.file_patch_arrays(cut, "page_id")
    b = TS.window_bounds(_pages(spark, sf).select("page_id", (B.n_data_patches("content") + 2).alias("n_patches")), "page_id")
    return b.join(a, "page_id").select("page_id", "n_patches", "choice", "start_patch", "kept_patches",
                                       _md5_of(F.flatten("patches")).alias("symbols_md5"))


@register("pad_batch", f"""WITH {_SYMBOLS_SQL},
_m AS (SELECT *, max(len(symbols)) OVER (PARTITION BY batch_no) AS longest FROM sym)
SELECT page_id, batch_no, CAST(longest AS INTEGER) AS length,
       md5(array_to_string(list_concat(symbols, list_transform(range(longest - len(symbols)), lambda x: 256)), ',')) AS padded_md5,
       md5(array_to_string(list_concat(list_transform(range(len(symbols) // 16), lambda x: 1), list_transform(range((longest - len(symbols)) // 16), lambda x: 0)), ',')) AS mask_md5
FROM _m""")
def q_pad_batch(spark, sf):
    b = TS.pad_batches(_windows(spark, sf), "row", "symbols", BATCH)
    return b.select("page_id", F.col("batch_no").cast("int"), F.size("padded").alias("length"),
                    _md5_of(F.col("padded")).alias("padded_md5"), _md5_of(F.col("mask")).alias("mask_md5"))


@register("batch_max_length", f"""WITH {_SYMBOLS_SQL}
SELECT batch_no, CAST(max(len(symbols)) AS INTEGER) AS max_length, count(*) AS n_files FROM sym GROUP BY batch_no""")
def q_batch_max_length(spark, sf):
    w = TS.minibatch(_windows(spark, sf), "row", BATCH)
    return w.groupBy(F.col("batch_no").cast("int").alias("batch_no")).agg(
        F.max(F.size("symbols")).alias("max_length"), F.count(F.lit(1)).alias("n_files"))


@register("left_shift_mask", f"""WITH {_SYMBOLS_SQL},
_m AS (SELECT *, max(len(symbols)) OVER (PARTITION BY batch_no) // 16 AS padded, len(symbols) // 16 AS n FROM sym),
_k AS (SELECT page_id, list_transform(range(padded), lambda i: CASE WHEN i < n - 1 THEN 1 ELSE 0 END) AS predict,
              list_transform(range(padded), lambda i: CASE WHEN i > 0 AND i < n THEN 1 ELSE 0 END) AS target FROM _m)
SELECT page_id, md5(array_to_string(predict, ',')) AS predict_md5, md5(array_to_string(target, ',')) AS target_md5,
       CAST(list_sum(predict) AS BIGINT) AS n_predictors FROM _k""")
def q_left_shift_mask(spark, sf):
    b = TS.pad_batches(_windows(spark, sf), "row", "symbols", BATCH)
    m = b.select("page_id", TS.left_shift_mask("mask").alias("predict"), TS.target_mask("mask").alias("target"))
    return m.select("page_id", _md5_of(F.col("predict")).alias("predict_md5"), _md5_of(F.col("target")).alias("target_md5"),
                    F.aggregate("predict", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_predictors"))


_BYTE_VALUES = f"""{PAGES},
_v AS (SELECT page_id, {ints_sql("h")} AS v FROM _pn)"""


@register("mask_msb", f"""WITH {_BYTE_VALUES}
SELECT page_id, CAST(len(v) AS INTEGER) AS n_bytes, CAST(len(list_filter(v, lambda x: x > 127)) AS INTEGER) AS n_masked,
       md5(array_to_string(list_transform(v, lambda x: CASE WHEN x > 127 THEN x & 127 ELSE x END), ',')) AS masked_md5
FROM _v""")
def q_mask_msb(spark, sf):
    v = _pages(spark, sf).select("page_id", B.to_ints("content").alias("v"))
    m = B.mask_msb("v")
    return v.select("page_id", F.size("v").alias("n_bytes"), B.count_non_ascii("v").alias("n_masked"),
                    _md5_of(m).alias("masked_md5"))


@register("shift_right_bytes", f"""WITH {_BYTE_VALUES}
SELECT page_id, CAST(len(v) AS INTEGER) AS n_bytes,
       md5(array_to_string(list_transform(v, lambda x: x >> 1), ',')) AS shifted_md5 FROM _v""")
def q_shift_right_bytes(spark, sf):
    v = _pages(spark, sf).select("page_id", B.to_ints("content").alias("v"))
    return v.select("page_id", F.size("v").alias("n_bytes"),
                    _md5_of(B.shift_right("v")).alias("shifted_md5"))


@register("masked_byte_count", f"""WITH {_BYTE_VALUES}
SELECT CAST(sum(len(list_filter(v, lambda x: x > 127))) AS BIGINT) AS n_masked, CAST(sum(len(v)) AS BIGINT) AS n_bytes FROM _v""")
def q_masked_byte_count(spark, sf):
    v = _pages(spark, sf).select(B.to_ints("content").alias("v"))
    return v.agg(F.sum(B.count_non_ascii("v")).cast("long").alias("n_masked"),
                 F.sum(F.size("v")).cast("long").alias("n_bytes"))


_BITS_SQL = f"""{_BYTE_VALUES},
_bits AS (SELECT page_id, ltrim(array_to_string(list_transform(v, lambda x: lpad(bin(x), 8, '0')), ''), '0') AS bits FROM _v)"""


@register("bits_to_bytes", f"""WITH {_BITS_SQL}
SELECT page_id, CAST(length(bits) AS INTEGER) AS n_bits,
       CAST((length(bits) + 7) // 8 * 8 - length(bits) AS INTEGER) AS pad,
       CAST((length(bits) + 7) // 8 AS INTEGER) AS n_bytes, md5(b) AS data_md5 FROM _bits JOIN _pn USING (page_id)""")
def q_bits_to_bytes(spark, sf):
    bits = _bits(spark, sf)
    s = B.bits_to_bytes("bits")
    return bits.select("page_id", F.length("bits").alias("n_bits"), s["pad"].alias("pad"),
                       F.octet_length(s["data"]).alias("n_bytes"), F.md5(s["data"]).alias("data_md5"))


def _bits(spark, sf):
    v = _pages(spark, sf).select("page_id", B.to_ints("content").alias("v"))
    return v.select("page_id", F.regexp_replace(B.ints_to_bits("v"), "^0+", "").alias("bits"))


@register("bytes_to_bits", f"""WITH {_BITS_SQL}
SELECT page_id, md5(bits) AS bits_md5, CAST(length(bits) AS INTEGER) AS n_bits FROM _bits""")
def q_bytes_to_bits(spark, sf):
    bits = _bits(spark, sf)
    s = B.bits_to_bytes("bits")
    back = B.bytes_to_bits(s["data"], s["pad"])
    return bits.select("page_id", F.md5(back).alias("bits_md5"), F.length(back).alias("n_bits"))


# A document's UTF-8 bytes as coded blocks of at most 65,535: an over-long one is split, an empty one is one empty block.
_BLOCKS_SQL = """
_bd AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents),
_bn AS (SELECT doc_id, b, n, unnest(range(0, greatest(CAST(ceil(n / 65535) AS INTEGER), 1))) AS k FROM _bd),
_bl AS (SELECT doc_id, CAST(k AS INTEGER) AS block_no, unhex(substr(hex(b), k * 131070 + 1, 131070)) AS payload FROM _bn),
_bs AS (SELECT doc_id, block_no, payload, CAST(octet_length(payload) % 8 AS INTEGER) AS pad, CAST(octet_length(payload) AS INTEGER) AS len FROM _bl)"""


def _blocks(spark, sf):
    from tessera.operators import codec as C
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    b = C.to_blocks(d, "doc_id", "data", B.MAX_BLOCK_LENGTH).withColumnRenamed("data", "payload")
    return b.select("doc_id", "block_no", "payload", (F.octet_length("payload") % 8).alias("pad"), F.octet_length("payload").alias("length"))


def _stored_blocks(spark, sf):
    from tessera.session import scratch_path
    from tessera.sources import tables as TB
    path = scratch_path(spark, "blocks")
    TB.write_blocks(_blocks(spark, sf), path)
    return TB.read_blocks(spark, path)


@register("write_blocks", f"""WITH {_BLOCKS_SQL}
SELECT doc_id, block_no, lpad(hex(pad), 2, '0') || lpad(hex(len), 4, '0') AS header_hex, CAST(octet_length(payload) + 3 AS INTEGER) AS blob_bytes,
       md5(unhex(lpad(hex(pad), 2, '0') || lpad(hex(len), 4, '0')) || payload) AS blob_md5 FROM _bs""")
def q_write_blocks(spark, sf):
    b = _stored_blocks(spark, sf)
    return b.select("doc_id", "block_no", F.hex(F.substring("blob", 1, 3)).alias("header_hex"),
                    F.octet_length("blob").alias("blob_bytes"), F.md5("blob").alias("blob_md5"))


@register("scan_blocks", f"""WITH {_BLOCKS_SQL}
SELECT doc_id, block_no, pad, len AS length, md5(payload) AS payload_md5 FROM _bs""")
def q_scan_blocks(spark, sf):
    b = _stored_blocks(spark, sf)
    return b.select("doc_id", "block_no", F.col("pad_bits").alias("pad"), F.col("n_symbols").alias("length"),
                    F.md5("payload_bytes").alias("payload_md5"))


_TRACE_SQL = f"""{PAGES},
_st AS (SELECT page_id, h, unnest(range(0, greatest(CAST(floor((octet_length(b) - 1024) / 16) AS INTEGER), 0))) AS step FROM _pn),
_rec AS (SELECT page_id, CAST(step AS INTEGER) AS step, {ints_sql("substr(h, (1024 + step * 16) * 2 + 1, 32)")} AS r FROM _st)"""


@register("scan_fixed_records", f"""WITH {_TRACE_SQL}
SELECT page_id, step, r[1] AS pc, r[2] AS acc, r[3:6] AS ir, r[7:16] AS registers FROM _rec""")
def q_scan_fixed_records(spark, sf):
    return P.decode_trace(_pages(spark, sf), "page_id", "content")


_OPS_SQL = "[" + ", ".join(f"'{o}'" for o in P.OPCODES) + "]"
_REGS_SQL = "[" + ", ".join(f"'{r}'" for r in P.REGISTERS) + "]"


# Page bytes are text, whose codes lie beyond the 21 opcodes: records are folded into the valid ranges.
@register("opcode_name", f"""WITH {_TRACE_SQL},
_i AS (SELECT r[3] % 22 AS op, r[4] % 11 AS a1, r[5] % 11 AS a2, r[6] % 11 AS a3 FROM _rec),
_n AS (SELECT CASE WHEN op > 20 THEN NULL ELSE
         trim({_OPS_SQL}[op + 1] || ' ' || CASE WHEN op = 11 THEN CAST(a1 AS VARCHAR) WHEN a1 = 0 THEN '' ELSE {_REGS_SQL}[a1] END
              || ' ' || CASE WHEN a2 = 0 THEN '' ELSE {_REGS_SQL}[a2] END || ' ' || CASE WHEN a3 = 0 THEN '' ELSE {_REGS_SQL}[a3] END) END AS asm FROM _i)
SELECT asm, count(*) AS n FROM _n GROUP BY asm""")
def q_opcode_name(spark, sf):
    t = P.decode_trace(_pages(spark, sf), "page_id", "content")
    folded = F.transform("ir", lambda x, i: F.when(i == 0, x % 22).otherwise(x % 11))
    return t.select(folded.alias("ir")).groupBy(P.opcode_name("ir").alias("asm")).agg(F.count(F.lit(1)).alias("n"))


_GREEDY_SQL = f"""{MODEL},
_am AS (SELECT a, b AS pred FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n_ab DESC, b) AS r FROM model) WHERE r = 1),
_dc AS (SELECT doc_id, lang, string_split(text, '') AS c FROM documents),
_dp AS (SELECT doc_id, lang, len(c) AS n, unnest(c[1 : len(c) - 1]) AS a, unnest(c[2 : len(c)]) AS b FROM _dc),
_bm AS (SELECT d.doc_id, d.lang, length(d.text) AS n_total, count(*) FILTER (WHERE _am.pred = _dp.b) AS n_matched
        FROM documents d LEFT JOIN _dp ON d.doc_id = _dp.doc_id LEFT JOIN _am ON _dp.a = _am.a GROUP BY ALL)"""


def _greedy_match(spark, sf):
    docs = table(spark, sf, "documents")
    model = lm.train_bigram(docs)
    best = lm.ranked(model).filter(F.col("sym_rank") == 1).select("a", F.col("b").alias("pred"))
    hits = lm.pair_counts(docs, "doc_id", "text").join(best, "a", "left").groupBy("doc_id").agg(
        F.sum(F.when(F.col("pred") == F.col("b"), F.col("n")).otherwise(0)).alias("n_matched"))
    sizes = docs.select("doc_id", "lang", F.length("text").alias("n_total"))
    return sizes.join(hits, "doc_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))


@register("byte_match", f"""WITH {_GREEDY_SQL}
SELECT doc_id, CAST(n_total AS INTEGER) AS n_total, n_matched FROM _bm""")
def q_byte_match(spark, sf):
    return _greedy_match(spark, sf).select("doc_id", "n_total", "n_matched")


@register("byte_accuracy", f"""WITH {_GREEDY_SQL}
SELECT lang, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_total) AS BIGINT) AS n_total,
       round(sum(n_matched) / sum(n_total), 6) AS accuracy FROM _bm GROUP BY ROLLUP (lang)""")
def q_byte_accuracy(spark, sf):
    m = _greedy_match(spark, sf)
    return m.rollup("lang").agg(F.sum("n_matched").cast("long").alias("n_matched"),
                                F.sum("n_total").cast("long").alias("n_total")).withColumn(
        "accuracy", F.round(F.col("n_matched") / F.col("n_total"), 6))
