"""Registered media queries over page bytes used as rasters (64 pixels wide) and 8-bit PCM."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import media as MD
from tessera.operators.patches import verify_roundtrip
from tessera.session import table

RASTER_WIDTH = 64
SEGMENT_START_S, SEGMENT_DURATION_S = 2.0, 1.0

_IMG_SQL = f"""
_img AS (SELECT page_id, {RASTER_WIDTH} AS width, CAST(ceil(octet_length(encode(html)) / {RASTER_WIDTH}) AS INTEGER) AS height FROM pages),
_t1 AS (SELECT page_id, width, height, unnest(range(0, CAST(ceil(height / 32) AS INTEGER))) AS row FROM _img),
grid AS (SELECT page_id, width, height, CAST(row AS INTEGER) AS row,
                CAST(unnest(range(0, CAST(ceil(width / 32) AS INTEGER))) AS INTEGER) AS col FROM _t1)"""


def _images(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
    h = F.ceil(F.octet_length("b") / RASTER_WIDTH).cast("int")
    pad = F.unhex(F.repeat(F.lit("00"), h * RASTER_WIDTH - F.octet_length("b")))
    return p.select("page_id", F.lit(RASTER_WIDTH).alias("width"), h.alias("height"),
                    F.concat("b", pad).alias("pixels"))


@register("split_tiles", f"""WITH {_IMG_SQL}
SELECT g.page_id, row, col, col * 32 AS x, row * 32 AS y, least(32, width - col * 32) AS w, least(32, height - row * 32) AS h,
       md5(unhex(array_to_string(list_transform(range(least(32, height - row * 32)),
           lambda r: substr(rpad(hex(encode(html)), width * height * 2, '0'), ((row * 32 + r) * width + col * 32) * 2 + 1, least(32, width - col * 32) * 2)), ''))) AS tile_md5
FROM grid g JOIN pages USING (page_id)""")
def q_split_tiles(spark, sf):
    t = MD.split_tiles(_images(spark, sf), "page_id", "width", "height", "pixels")
    return t.select("page_id", "row", "col", "x", "y", "w", "h", F.md5("tile").alias("tile_md5"))


@register("merge_tiles", f"""WITH {_IMG_SQL}
SELECT DISTINCT page_id, true AS equal, CAST(width * height AS INTEGER) AS original_bytes, CAST(width * height AS INTEGER) AS rebuilt_bytes,
       CAST(NULL AS INTEGER) AS first_diff FROM grid""")
def q_merge_tiles(spark, sf):
    img = _images(spark, sf)
    merged = MD.merge_tiles(MD.split_tiles(img, "page_id", "width", "height", "pixels"), "page_id")
    return verify_roundtrip(img.select("page_id", F.col("pixels").alias("data")),
                            merged.select("page_id", F.col("pixels").alias("data")), "page_id")


# Every third tile row loses its second tile: missing tiles are found, unless they were the last.
@register("image_extent", f"""WITH {_IMG_SQL},
_kept AS (SELECT page_id, row, col, col * 32 + least(32, width - col * 32) AS x2, row * 32 + least(32, height - row * 32) AS y2 FROM grid
          WHERE NOT (row % 3 = 1 AND col = 1)),
_ext AS (SELECT page_id, CAST(max(x2) AS INTEGER) AS width, CAST(max(y2) AS INTEGER) AS height, count(*) AS n_tiles FROM _kept GROUP BY page_id)
SELECT page_id, width, height, n_tiles, CAST(ceil(width / 32) * ceil(height / 32) AS BIGINT) - n_tiles AS n_missing FROM _ext""")
def q_image_extent(spark, sf):
    t = MD.split_tiles(_images(spark, sf), "page_id", "width", "height", "pixels").drop("tile")
    t = t.filter(~((F.col("row") % 3 == 1) & (F.col("col") == 1)))
    return MD.image_extent(t, "page_id").select("page_id", "width", "height", "n_tiles", "n_missing")


def _audio(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("pcm"))
    return p.select("page_id", MD.wav_blob("pcm").alias("wav"))


_AUD_SQL = "_a AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages)"


@register("scan_wav_info", f"""WITH {_AUD_SQL}
SELECT page_id, CAST(1 AS BIGINT) AS nchannels, CAST(1 AS BIGINT) AS sampwidth, CAST(8000 AS BIGINT) AS framerate,
       n AS nframes, round(n / 8000, 6) AS duration FROM _a""")
def q_scan_wav_info(spark, sf):
    return MD.wav_info(_audio(spark, sf), "page_id", "wav").withColumn("duration", F.round("duration", 6))


@register("split_audio", f"""WITH {_AUD_SQL}
SELECT page_id, CAST(s // 8000 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start_byte, CAST(least(8000, n - s) AS INTEGER) AS n_bytes,
       md5(unhex(substr(h, s * 2 + 1, 16000))) AS frames_md5
FROM (SELECT page_id, n, h, unnest(range(0, n, 8000)) AS s FROM _a JOIN (SELECT page_id, hex(encode(html)) AS h FROM pages) USING (page_id))""")
def q_split_audio(spark, sf):
    c = MD.split_audio(_audio(spark, sf), "page_id", "wav")
    return c.select("page_id", "chunk_no", "start_byte", F.octet_length("frames").alias("n_bytes"), F.md5("frames").alias("frames_md5"))


@register("merge_audio", f"""WITH {_AUD_SQL}
SELECT page_id, true AS equal, CAST(n + 44 AS INTEGER) AS original_bytes, CAST(n + 44 AS INTEGER) AS rebuilt_bytes,
       CAST(NULL AS INTEGER) AS first_diff FROM _a""")
def q_merge_audio(spark, sf):
    a = _audio(spark, sf)
    merged = MD.merge_audio(MD.split_audio(a, "page_id", "wav"), "page_id")
    return verify_roundtrip(a.select("page_id", F.col("wav").alias("data")),
                            merged.select("page_id", F.col("wav").alias("data")), "page_id")


@register("audio_segment", f"""WITH {_AUD_SQL},
_s AS (SELECT page_id, n, n * 1000 / 8000 AS dur_ms, hex(encode(html)) AS h FROM _a JOIN pages USING (page_id))
SELECT page_id, CASE WHEN 2000 >= dur_ms THEN 'start_past_end' ELSE 'ok' END AS status,
       CASE WHEN 2000 < dur_ms THEN 2000 END AS start_ms,
       CASE WHEN 2000 < dur_ms THEN CAST(floor(least(3000.0, dur_ms)) AS BIGINT) END AS end_ms,
       CASE WHEN 2000 < dur_ms THEN CAST(floor(least(3000.0, dur_ms) * 8) - 16000 AS INTEGER) END AS n_bytes,
       CASE WHEN 2000 < dur_ms THEN md5(unhex(substr(h, 32001, 2 * CAST(floor(least(3000.0, dur_ms) * 8) - 16000 AS INTEGER)))) END AS frames_md5
FROM _s""")
def q_audio_segment(spark, sf):
    s = MD.audio_segment(_audio(spark, sf), "page_id", "wav", SEGMENT_START_S, SEGMENT_DURATION_S)
    return s.select("page_id", "status", "start_ms", "end_ms", F.octet_length("frames").alias("n_bytes"), F.md5("frames").alias("frames_md5"))


@register("split_good_bad", """
SELECT page_id, false AS wrapped, CASE WHEN substr(html, 1, 4) = 'RIFF' AND substr(html, 9, 4) = 'WAVE' THEN 'ok' ELSE 'not_wav' END AS status,
       CASE WHEN substr(html, 1, 4) = 'RIFF' AND substr(html, 9, 4) = 'WAVE' THEN 0 ELSE 1 END AS n_failed FROM pages
UNION ALL SELECT page_id, true AS wrapped, 'ok' AS status, 0 AS n_failed FROM pages""")
def q_split_good_bad(spark, sf):
    # Every page once as raw bytes (not a WAV file) and once wrapped as WAV: the
    # bad rows are reported, not fatal, and both kinds are counted.
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
    files = p.select("page_id", F.lit(False).alias("wrapped"), F.col("b").alias("blob")).unionByName(
        p.select("page_id", F.lit(True).alias("wrapped"), MD.wav_blob("b").alias("blob")))
    ok = (F.substring("blob", 1, 4) == F.encode(F.lit("RIFF"), "US-ASCII")) & \
         (F.substring("blob", 9, 4) == F.encode(F.lit("WAVE"), "US-ASCII"))
    return files.select("page_id", "wrapped", F.when(ok, "ok").otherwise("not_wav").alias("status"), F.when(ok, 0).otherwise(1).alias("n_failed"))


@register("scan_image", f"""WITH {_IMG_SQL},
_px AS (SELECT page_id, regexp_replace(rpad(hex(encode(html)), CAST(2 * {RASTER_WIDTH} * ceil(octet_length(encode(html)) / {RASTER_WIDTH}) AS INTEGER), '0'), '(..)', '\\1\\1\\1', 'g') AS p FROM pages)
SELECT DISTINCT 'page_' || CAST(page_id AS VARCHAR) || '.bmp' AS name, width, height, 3 AS n_channels, true AS ok, md5(unhex(p)) AS pixels_md5
FROM grid JOIN _px USING (page_id)""")
def q_scan_image(spark, sf):
    from tessera.session import scratch_path
    from tessera.sources import files as FS

    root = scratch_path(spark, "images")
    img = _images(spark, sf)
    bmp = img.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".bmp")).alias("name"),
                     MD.bmp_blob("pixels", "width", "height").alias("blob"))
    FS.write_files(bmp, root, "name", "blob").write.format("noop").mode("overwrite").save()
    imgs = FS.read_images(spark, root)
    return imgs.select(F.substring_index("path", "/", -1).alias("name"), "width", "height", "n_channels", "ok", F.md5("data").alias("pixels_md5"))
