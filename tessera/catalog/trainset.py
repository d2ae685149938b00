"""Registered training-set queries over pseudo file listings derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.catalog.bytes import ints_sql, pad16_sql
from tessera.operators import trainset as TS
from tessera.session import table

# Pseudo file listings: documents as "<lang>/<source>_<doc_id>.<lang>", conversation turns as
# "conv/<conv_id>_<exchange>.<role>" (a user turn and its answer share a stem), pages as "web/page_<id>.html".
DOC_FILES_SQL = """
files AS (SELECT doc_id, lang || '/' || source || '_' || CAST(doc_id AS VARCHAR) || '.' || lang AS path,
                 lang AS ext, lang || '/' || source || '_' || CAST(doc_id AS VARCHAR) AS stem,
                 source || '.' || lang AS label FROM documents)"""
TURN_FILES_SQL = """
tfiles AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn // 2 AS VARCHAR) || '.' || role AS path,
                  role AS ext, 'conv/' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn // 2 AS VARCHAR) AS stem FROM conversations)"""


def doc_files(spark, sf, *keep):
    d = table(spark, sf, "documents")
    path = F.concat_ws("", "lang", F.lit("/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return TS.path_columns(d.select("doc_id", path.alias("path"), *keep))


def turn_files(spark, sf):
    c = table(spark, sf, "conversations")
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("_"),
                    F.floor(F.col("turn") / 2).cast("string"), F.lit("."), F.col("role"))
    return TS.path_columns(c.select(path.alias("path")))


@register("path_columns", f"WITH {DOC_FILES_SQL} SELECT path, ext, stem, label FROM files")
def q_path_columns(spark, sf):
    return doc_files(spark, sf).select("path", "ext", "stem", "label")


@register("filter_ext", f"WITH {DOC_FILES_SQL} SELECT path FROM files WHERE ext = 'en'")
def q_filter_ext(spark, sf):
    return doc_files(spark, sf).filter(F.col("ext") == "en").select("path")


# Pages as image files of all seven kinds, upper case too, between files of other kinds.
_KINDS = ["png", "JPG", "jpeg", "BMP", "gif", "Tiff", "webp", "html", "txt", "png2", "jpgx"]


@register("scan_multi_ext", f"""
WITH _f AS (SELECT page_id, {_KINDS!r}[CAST(page_id % {len(_KINDS)} AS INTEGER) + 1] AS kind FROM pages)
SELECT 'img/page_' || CAST(page_id AS VARCHAR) || '.' || kind AS path, kind AS ext FROM _f
WHERE lower(kind) IN ('png', 'jpg', 'jpeg', 'bmp', 'gif', 'tiff', 'webp')""")
def q_scan_multi_ext(spark, sf):
    from tessera.sources.files import IMAGE_EXTENSIONS, ext_filter
    kinds = F.array(*map(F.lit, _KINDS))
    kind = F.element_at(kinds, (F.col("page_id") % len(_KINDS)).cast("int") + 1)
    files = table(spark, sf, "pages").select(F.concat(F.lit("img/page_"), F.col("page_id").cast("string"), F.lit("."), kind).alias("path"))
    return TS.path_columns(files.filter(F.col("path").rlike(ext_filter(IMAGE_EXTENSIONS)))).select("path", "ext")


@register("label_ids", f"""WITH {DOC_FILES_SQL}
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS label_id FROM (SELECT DISTINCT label FROM files)""")
def q_label_ids(spark, sf):
    return TS.label_ids(doc_files(spark, sf)).select("label", "label_id")


@register("label_join", f"""WITH {DOC_FILES_SQL},
ids AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS label_id FROM (SELECT DISTINCT label FROM files))
SELECT f.path, i.label_id FROM files f JOIN ids i ON f.label = i.label""")
def q_label_join(spark, sf):
    f = doc_files(spark, sf)
    return TS.label_join(f, TS.label_ids(f)).select("path", "label_id")


@register("pair_unidirectional", f"""WITH {TURN_FILES_SQL}
SELECT i.path AS input_path, t.path AS target_path FROM tfiles i JOIN tfiles t ON i.stem = t.stem
WHERE i.ext = 'user' AND t.ext = 'assistant'""")
def q_pair_unidirectional(spark, sf):
    return TS.pairs_unidirectional(turn_files(spark, sf), "user", "assistant")


@register("pair_bidirectional", f"""WITH {TURN_FILES_SQL},
_p AS (SELECT i.path AS input_path, t.path AS target_path FROM tfiles i JOIN tfiles t ON i.stem = t.stem
       WHERE i.ext = 'user' AND t.ext = 'assistant')
SELECT * FROM _p UNION ALL SELECT * FROM _p""")
def q_pair_bidirectional(spark, sf):
    return TS.pairs_bidirectional(turn_files(spark, sf), "user", "assistant")


@register("union_folders", f"""WITH {DOC_FILES_SQL}
SELECT path, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM files JOIN documents USING (doc_id)
UNION ALL SELECT 'web/page_' || CAST(page_id AS VARCHAR) || '.html' AS path, CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes FROM pages""")
def q_union_folders(spark, sf):
    d = doc_files(spark, sf, F.octet_length("text").alias("n_bytes")).select("path", "n_bytes")
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").alias("n_bytes"))
    return d.unionByName(p)


ODD_BATCH = 7        # leaves a remainder at the usual table sizes


_SHUFFLE_SQL = f"""{DOC_FILES_SQL},
sh AS (SELECT path, CAST(row_number() OVER (ORDER BY md5('{TS.SEED}:' || path), path) - 1 AS BIGINT) AS shuffle_rank FROM files)"""


def _shuffled(spark, sf):
    return TS.seeded_shuffle(doc_files(spark, sf).select("path"), "path")


@register("seeded_shuffle", f"WITH {_SHUFFLE_SQL} SELECT path, shuffle_rank FROM sh")
def q_seeded_shuffle(spark, sf):
    return _shuffled(spark, sf)


@register("train_eval_split", f"""WITH {_SHUFFLE_SQL}
SELECT path, CASE WHEN shuffle_rank < floor((SELECT count(*) FROM files) * {TS.EVAL_SPLIT}) THEN 'eval' ELSE 'train' END AS split FROM sh""")
def q_train_eval_split(spark, sf):
    return TS.train_eval_split(doc_files(spark, sf).select("path"), "path").select("path", "split")


@register("drop_remainder", f"""WITH {_SHUFFLE_SQL}
SELECT path, shuffle_rank FROM sh WHERE shuffle_rank < (SELECT count(*) - count(*) % {ODD_BATCH} FROM files)""")
def q_drop_remainder(spark, sf):
    return TS.drop_remainder(_shuffled(spark, sf), "shuffle_rank", ODD_BATCH)


@register("minibatch", f"""WITH {_SHUFFLE_SQL}
SELECT path, shuffle_rank, shuffle_rank // {TS.BATCH_SIZE} AS batch_no FROM sh""")
def q_minibatch(spark, sf):
    return TS.minibatch(_shuffled(spark, sf), "shuffle_rank")


def _file_symbols_sql(p: str) -> str:
    """Symbols of a file but for its end patch: extension patch and data patches, padded."""
    return (f"list_concat(list_concat({pad16_sql(ints_sql(p + 'x'))}, {ints_sql(p + 'h')}), "
            f"list_transform(range((16 - (length({p}h) // 2) % 16) % 16), lambda x: 256))")


@register("concat_pair", f"""WITH {TURN_FILES_SQL.replace("AS stem FROM conversations", "AS stem, CAST(ceil(octet_length(encode(text)) / 16) AS INTEGER) + 2 AS n_patches, hex(encode(text)) AS h, hex(encode(role)) AS x FROM conversations")},
_p AS (SELECT i.path AS input_path, t.path AS target_path, i.n_patches AS n_in, t.n_patches AS n_tgt, i.h AS ih, t.h AS th, i.x AS ix, t.x AS tx
       FROM tfiles i JOIN tfiles t ON i.stem = t.stem WHERE i.ext = 'user' AND t.ext = 'assistant')
SELECT input_path, target_path, CAST(least(1024, n_in - 1 + n_tgt) AS INTEGER) AS n_patches, CAST(n_in - 1 AS INTEGER) AS target_start,
       md5(array_to_string(list_concat(list_concat({_file_symbols_sql("i")}, {_file_symbols_sql("t")}), list_transform(range(16), lambda x: 256))[1 : 16384], ',')) AS symbols_md5
FROM _p""")
def q_concat_pair(spark, sf):
    from tessera.operators.patches import to_patches
    c = table(spark, sf, "conversations")
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("_"),
                    F.floor(F.col("turn") / 2).cast("string"), F.lit("."), F.col("role"))
    files = c.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"), F.col("role").alias("ext"))
    arrays = TS.file_patch_arrays(to_patches(files, "path", "content", ext="ext"), "path")
    pairs = TS.pairs_unidirectional(turn_files(spark, sf), "user", "assistant")
    j = pairs.join(arrays.select(F.col("path").alias("input_path"), F.col("patches").alias("a")), "input_path") \
             .join(arrays.select(F.col("path").alias("target_path"), F.col("patches").alias("b")), "target_path")
    seq = TS.concat_pair(F.col("a"), F.col("b"))
    return j.select("input_path", "target_path", F.size(seq).alias("n_patches"), (F.size("a") - 1).alias("target_start"),
                    F.md5(F.array_join(F.flatten(seq), ",")).alias("symbols_md5"))
