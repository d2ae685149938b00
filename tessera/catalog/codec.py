"""Registered codec queries: compress/decompress with the lane coder, gzip and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import codec as C
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.plans import compression as J
from tessera.session import scratch_path, table
from tessera.sources import tables as TB


@register("compress_corpus")
def q_compress_corpus(spark, sf):
    blocks, _ = J.compress_corpus(J.corpus_bytes(spark, sf))
    return blocks.select("doc_id", "block_no", "model_id", "n_symbols", "n_bytes")


@register("decompress_corpus", "SELECT doc_id, text FROM documents")
def q_decompress_corpus(spark, sf):
    """Blocks and model are stored; another session loads both and decodes."""
    data = J.corpus_bytes(spark, sf)
    blocks, model = J.compress_corpus(data)
    folder = scratch_path(spark, "coded")
    TB.save_byte_model(spark, model, f"{folder}/models")
    blocks.write.parquet(f"{folder}/blocks")
    other = spark.newSession()
    stored_blocks = other.read.parquet(f"{folder}/blocks")
    out = J.decompress_corpus(stored_blocks, TB.load_byte_model(other, f"{folder}/models", model.model_id))
    return out.select("doc_id", F.decode("data", "UTF-8").alias("text"))


@register("rag_compress_roundtrip", "SELECT item_id, text FROM benchmark")
def q_rag_compress_roundtrip(spark, sf):
    """Benchmark items coded under a model steered by their retrieved chunks; only chunk ids are in the
    block. Another session loads index, model and blocks, looks the context up and decodes."""
    folder = scratch_path(spark, "rag-coded")
    chunks = R.build_chunks(table(spark, sf, "documents"))
    TB.save_index(chunks, f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    items = table(spark, sf, "benchmark")
    hits = R.knn_sparse(items, index, k=R.RAG_TOP_K)
    model = J.fit_model(J.corpus_bytes(spark, sf))
    TB.save_byte_model(spark, model, f"{folder}/models")
    rows = J.with_context(items.select("item_id", F.encode("text", "UTF-8").alias("data")), hits, index, "item_id")
    C.compress_with_context(rows, model, "item_id").write.parquet(f"{folder}/blocks")
    other = spark.newSession()
    blocks = J.context_of_blocks(other.read.parquet(f"{folder}/blocks"), other.read.parquet(f"{folder}/index"), "item_id")
    back = C.decompress_with_context(blocks, TB.load_byte_model(other, f"{folder}/models", model.model_id), "item_id")
    return back.select("item_id", F.decode("data", "UTF-8").alias("text"))


@register("predictor_roundtrip", "SELECT doc_id, text FROM documents")
def q_predictor_roundtrip(spark, sf):
    """Documents coded by asking a predictor (order two) for every byte; another session loads the predictor and
    the coded rows, asks again and decodes."""
    from tessera.operators import predictive as PR
    data = J.corpus_bytes(spark, sf)
    folder = scratch_path(spark, "predicted")
    PR.save_order_two(data, f"{folder}/predictor")
    factory, name = PR.order_two(spark, f"{folder}/predictor")
    PR.compress_predicted(C.to_blocks(data, "doc_id", "data", PR.BLOCK_SYMBOLS), factory, name).write.parquet(f"{folder}/coded")
    other = spark.newSession()
    factory, name = PR.order_two(other, f"{folder}/predictor")
    back = C.merge_blocks(PR.decompress_predicted(other.read.parquet(f"{folder}/coded"), factory, name), "doc_id")
    return back.select("doc_id", F.decode("data", "UTF-8").alias("text"))


_MEDIA_SQL = """
_r AS (SELECT page_id, encode(html) AS b, 64 * CAST(ceil(octet_length(encode(html)) / 64) AS INTEGER) AS size FROM pages)
SELECT page_id, 'bmp' AS kind, CAST(size AS INTEGER) AS n_bytes, md5(unhex(rpad(hex(b), 2 * size, '0'))) AS content_md5 FROM _r
UNION ALL SELECT page_id, 'wav' AS kind, CAST(octet_length(b) AS INTEGER) AS n_bytes, md5(b) AS content_md5 FROM _r"""


@register("media_codec_roundtrip", f"WITH {_MEDIA_SQL}")
def q_media_codec_roundtrip(spark, sf):
    """Tiles of rasters and seconds of audio in one table of pieces, each coded with the model of its kind over bytes
    and the padding symbol; decoded in another session, merged, and read as pixels and frames."""
    from tessera.catalog import media as CM
    from tessera.operators import keyed as K
    from tessera.operators import media as MD
    folder = scratch_path(spark, "media-coded")
    none = F.lit(None).cast("int")
    tiles = MD.split_tiles(CM._images(spark, sf), "page_id", "width", "height", "pixels")
    sound = MD.split_audio(CM._audio(spark, sf), "page_id", "wav")
    keep = ["page_id", "x", "y", "w", "h", "chunk_no"]
    pieces = tiles.select("page_id", "x", "y", "w", "h", none.alias("chunk_no"), F.lit("bmp").alias("kind"), F.col("tile").alias("data")).unionByName(
        sound.select("page_id", *[none.alias(c) for c in "xywh"], "chunk_no", F.lit("wav").alias("kind"), F.col("frames").alias("data")))
    K.count_symbols(pieces).write.parquet(f"{folder}/models")
    K.compress_pieces(pieces, K.load_models(spark, f"{folder}/models"), keep).write.parquet(f"{folder}/pieces")
    other = spark.newSession()
    back = K.decompress_pieces(other.read.parquet(f"{folder}/pieces"), K.load_models(other, f"{folder}/models"), keep)
    images = MD.merge_tiles(back.where("kind = 'bmp'").withColumnRenamed("data", "tile"), "page_id").select("page_id", F.lit("bmp").alias("kind"), F.col("pixels").alias("data"))
    audio = MD.merge_audio(back.where("kind = 'wav'").withColumnRenamed("data", "frames"), "page_id").select(
        "page_id", F.lit("wav").alias("kind"), F.expr("substring(wav, 45)").alias("data"))
    return images.unionByName(audio).select("page_id", "kind", F.octet_length("data").alias("n_bytes"), F.md5("data").alias("content_md5"))


@register("codec_ratio")
def q_codec_ratio(spark, sf):
    data = J.corpus_bytes(spark, sf)
    blocks, _ = J.compress_corpus(data)
    s = J.codec_stats(blocks, data)
    return s.agg(F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes")) \
            .withColumn("ratio", F.col("original_bytes") / F.col("compressed_bytes"))


@register("gzip_corpus")
def q_gzip_corpus(spark, sf):
    d = J.corpus_bytes(spark, sf)
    g = d.select("doc_id", F.octet_length("data").alias("original_bytes"), C.gzip_bytes("data").alias("gz"))
    o, c = F.col("original_bytes"), F.octet_length("gz")
    return g.select("doc_id", "original_bytes", c.alias("gzip_bytes"),
                    F.round(M.ratio(o, c), 6).alias("ratio"), F.round(M.space_saved(o, c), 4).alias("space_saved_pct"))


@register("gunzip_corpus", "SELECT doc_id, text FROM documents")
def q_gunzip_corpus(spark, sf):
    d = J.corpus_bytes(spark, sf)
    back = d.select("doc_id", C.gunzip_bytes(C.gzip_bytes("data")).alias("data"))
    return back.select("doc_id", F.decode("data", "UTF-8").alias("text"))
