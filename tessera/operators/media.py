"""Image tiles and audio chunks as rows: split, read headers, cut segments, merge back.

Raw payloads stand in for decoded media: a raster is (width, height, pixel
bytes, row-major, one byte per pixel) and audio is 8-bit mono PCM with a
WAV header (read by walking its chunks). Splits are narrow generators over binary ``substring``;
merges are one output row per file, pasted with numpy in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference behaviour.
TILE_SIZE = 32            # square tiles, smaller at the right and bottom edges
AUDIO_RATE = 8000         # frames per second
AUDIO_CHANNELS = 1
AUDIO_SAMPWIDTH = 1       # bytes per sample
CHUNK_SECONDS = 1.0


# ------------------------------------------------------------------ tiles

def _steps(n: Column) -> Column:
    """0..n-1, none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _tiles(width: str, height: str, size: int) -> Column:
    """Array of (row, col, x, y, w, h); edge tiles are cut to the image, an empty image has none."""
    w, h = F.col(width), F.col(height)
    rows, cols = F.ceil(h / size).cast("int"), F.ceil(w / size).cast("int")
    return F.transform(_steps(rows * cols), lambda i: F.struct(
        F.floor(i / cols).cast("int").alias("row"), (i % cols).alias("col"),
        ((i % cols) * size).alias("x"), (F.floor(i / cols).cast("int") * size).alias("y"),
        F.least(F.lit(size), w - (i % cols) * size).alias("w"),
        F.least(F.lit(size), h - F.floor(i / cols).cast("int") * size).alias("h")))


def tile_grid(images: DataFrame, id_col: str, width: str, height: str, size: int = TILE_SIZE) -> DataFrame:
    """(id, row, col, x, y, w, h): one row per tile."""
    return images.select(id_col, F.explode(_tiles(width, height, size)).alias("t")).select(id_col, "t.*")


def split_tiles(images: DataFrame, id_col: str, width: str, height: str, pixels: str,
                size: int = TILE_SIZE) -> DataFrame:
    """Tiles with their pixel bytes, cut beside the raster (narrow: no join, no shuffle)."""
    line = lambda t, r: F.hex(F.substring(F.col(pixels), (t["y"] + r) * F.col(width) + t["x"] + 1, t["w"]))
    cut = F.transform(_tiles(width, height, size), lambda t: F.struct(
        *[t[c].alias(c) for c in ("row", "col", "x", "y", "w", "h")],
        F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), t["h"] - 1), lambda r: line(t, r)), "")).alias("tile")))
    return images.select(id_col, F.explode(cut).alias("t")).select(id_col, "t.*")


def merge_tiles(tiles: DataFrame, id_col: str) -> DataFrame:
    """(id, width, height, pixels): tiles pasted by position (numpy, one image per group)."""

    def paste(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int((pdf["x"] + pdf["w"]).max())
        h = int((pdf["y"] + pdf["h"]).max())
        img = np.zeros((h, w), np.uint8)
        for x, y, tw, th, t in zip(pdf["x"], pdf["y"], pdf["w"], pdf["h"], pdf["tile"]):
            img[y:y + th, x:x + tw] = np.frombuffer(t, np.uint8).reshape(th, tw)
        return pd.DataFrame({id_col: [pdf[id_col].iloc[0]], "width": [w], "height": [h], "pixels": [img.tobytes()]})

    return tiles.groupBy(id_col).applyInPandas(paste, f"{id_col} long, width int, height int, pixels binary")


def image_extent(tiles: DataFrame, id_col: str, size: int = TILE_SIZE) -> DataFrame:
    """Width/height from the tiles, tile count, and tiles missing from the full grid (anti-join)."""
    ext = tiles.groupBy(id_col).agg(F.max(F.col("x") + F.col("w")).alias("width"),
                                    F.max(F.col("y") + F.col("h")).alias("height"),
                                    F.count(F.lit(1)).alias("n_tiles"))
    grid = tile_grid(ext, id_col, "width", "height", size).select(id_col, "row", "col")
    missing = grid.join(tiles.select(id_col, "row", "col"), [id_col, "row", "col"], "left_anti") \
                  .groupBy(id_col).agg(F.count(F.lit(1)).alias("n_missing"))
    return ext.join(missing, id_col, "left").fillna(0, ["n_missing"])


# ------------------------------------------------------------------ audio

def _le(n: Column, nbytes: int) -> Column:
    h = F.lpad(F.hex(n), 2 * nbytes, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (nbytes - 1 - i) + 1, 2) for i in range(nbytes)]))


def _read_le(b: Column, offset: Column | int, nbytes: int) -> Column:
    h = F.hex(F.substring(b, offset + 1, nbytes))
    return F.conv(F.concat(*[F.substring(h, 2 * (nbytes - 1 - i) + 1, 2) for i in range(nbytes)]), 16, 10).cast("long")


def wav_blob(pcm, rate: int = AUDIO_RATE, channels: int = AUDIO_CHANNELS, width: int = AUDIO_SAMPWIDTH) -> Column:
    """PCM frames wrapped in a 44-byte RIFF/WAVE header (little-endian fields)."""
    p = F.col(pcm) if isinstance(pcm, str) else pcm
    n = F.octet_length(p)
    lit = lambda v, k: _le(F.lit(v), k)
    return F.concat(F.encode(F.lit("RIFF"), "US-ASCII"), _le(n + 36, 4), F.encode(F.lit("WAVEfmt "), "US-ASCII"),
                    lit(16, 4), lit(1, 2), lit(channels, 2), lit(rate, 4), lit(rate * channels * width, 4),
                    lit(channels * width, 2), lit(8 * width, 2), F.encode(F.lit("data"), "US-ASCII"), _le(n, 4), p)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("fmt", "data", "size")]))
def wav_layout(blob: pd.Series) -> pd.DataFrame:
    """Byte offsets of the ``fmt `` and ``data`` chunk bodies and the data size, found by walking
    the RIFF chunks (others may stand before, between and after them); nulls if not such a file.
    A data size beyond the end of the file is cut to it."""
    rows = []
    for b in blob:
        found, at = {}, 12
        if b is not None and bytes(b[:4]) == b"RIFF" and bytes(b[8:12]) == b"WAVE":
            while at + 8 <= len(b):
                size = int.from_bytes(b[at + 4:at + 8], "little")
                found.setdefault(bytes(b[at:at + 4]), (at + 8, min(size, len(b) - at - 8)))
                at += 8 + size + size % 2
        fmt, data = found.get(b"fmt "), found.get(b"data")
        rows.append((fmt[0], *data) if fmt and fmt[1] >= 16 and data else (None, None, None))
    return pd.DataFrame(rows, columns=["fmt", "data", "size"]).astype("Int64")


def _opened(audio: DataFrame, id_col: str, blob: str) -> DataFrame:
    """(id, blob, l = layout, i = info) of readable audio and null info of other files."""
    x = audio.select(id_col, blob, wav_layout(blob).alias("l"))
    b, at = F.col(blob), F.col("l.fmt").cast("int")
    ch, rate = _read_le(b, at + 2, 2), _read_le(b, at + 4, 4)
    width = (_read_le(b, at + 14, 2) / 8).cast("long")
    frames = F.floor(F.try_divide("l.size", ch * width)).cast("long")
    info = F.struct(ch.alias("nchannels"), width.alias("sampwidth"), rate.alias("framerate"),
                    frames.alias("nframes"), F.try_divide(frames, rate).alias("duration"))
    return x.withColumn("i", F.when(F.col("l.fmt").isNotNull(), info))


def wav_info(audio: DataFrame, id_col: str, blob: str) -> DataFrame:
    """(id, nchannels, sampwidth, framerate, nframes, duration) read from the header chunks."""
    return _opened(audio, id_col, blob).select(id_col, "i.*")


def split_audio(audio: DataFrame, id_col: str, blob: str, seconds: float = CHUNK_SECONDS) -> DataFrame:
    """(id, chunk_no, start_byte, frames): chunks of int(rate*seconds) frames, the last one shorter;
    audio without frames is one empty chunk. Files that are no audio give no rows."""
    a = _opened(audio, id_col, blob).filter(F.col("i").isNotNull())
    frame_bytes = F.col("i.nchannels") * F.col("i.sampwidth")
    chunk = F.greatest((F.floor(F.col("i.framerate") * seconds) * frame_bytes).cast("int"), F.lit(1))
    total = (F.col("i.nframes") * frame_bytes).cast("int")
    x = a.select(id_col, blob, F.posexplode(F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1, chunk)).alias("chunk_no", "start_byte"),
                 chunk.alias("_chunk"), total.alias("_total"), (F.col("l.data") + 1).cast("int").alias("_from"))
    n = F.least(F.col("_chunk"), F.col("_total") - F.col("start_byte"))
    return x.select(id_col, "chunk_no", "start_byte", F.substring(blob, F.col("_from") + F.col("start_byte"), n).alias("frames"))


def merge_audio(chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, wav): chunks concatenated in chunk order under a rebuilt header."""
    pcm = F.expr("listagg(frames) WITHIN GROUP (ORDER BY chunk_no)")
    return chunks.groupBy(id_col).agg(pcm.alias("_pcm")).select(id_col, wav_blob("_pcm").alias("wav"))


def audio_segment(audio: DataFrame, id_col: str, blob: str, start_s: float, duration_s: float) -> DataFrame:
    """Frames of [start, start+duration) in milliseconds; the end is clamped to the audio,
    a negative start, one at/after the end, or a file that is no audio is an error row."""
    a = _opened(audio, id_col, blob)
    dur_ms = F.col("i.nframes") * 1000 / F.col("i.framerate")
    start_ms, end_req = F.lit(int(start_s * 1000)), F.lit(int((start_s + duration_s) * 1000))
    status = F.when(F.col("i").isNull(), "not_wav").when(start_ms < 0, "negative_start").when(start_ms >= dur_ms, "start_past_end").otherwise("ok")
    end_ms = F.least(end_req.cast("double"), dur_ms)
    fb = F.col("i.nchannels") * F.col("i.sampwidth")
    first = (F.floor(start_ms * F.col("i.framerate") / 1000) * fb).cast("int")
    last = (F.floor(end_ms * F.col("i.framerate") / 1000) * fb).cast("int")
    ok = status == "ok"
    return a.select(id_col, status.alias("status"),
                    F.when(ok, start_ms).alias("start_ms"), F.when(ok, end_ms.cast("long")).alias("end_ms"),
                    F.when(ok, F.substring(blob, (F.col("l.data") + 1).cast("int") + first, last - first)).alias("frames"))


def bmp_blob(pixels: str, width: str, height: str) -> Column:
    """24-bit BMP (bottom-up rows, gray value repeated as B, G, R) of a row-major raster.

    Rows are padded to a multiple of 4 bytes as the format requires.
    """
    w, h = F.col(width), F.col(height)
    pad = (4 - (w * 3) % 4) % 4
    row_hex = lambda r: F.concat(
        F.regexp_replace(F.hex(F.substring(F.col(pixels), (h - 1 - r) * w + 1, w)), "(..)", "$1$1$1"),
        F.repeat(F.lit("00"), pad))
    body = F.unhex(F.array_join(F.transform(_steps(h), row_hex), ""))
    size = (w * 3 + pad) * h
    lit = lambda v, k: _le(F.lit(v), k)
    return F.concat(F.encode(F.lit("BM"), "US-ASCII"), _le(size + 54, 4), lit(0, 4), lit(54, 4), lit(40, 4),
                    _le(w, 4), _le(h, 4), lit(1, 2), lit(24, 2), lit(0, 4), _le(size, 4),
                    lit(2835, 4), lit(2835, 4), lit(0, 4), lit(0, 4), body)
