"""Byte-level expressions on ``BinaryType`` columns and 257-symbol arrays.

A byte sequence with the pad/special symbol 256 does not fit in a byte, so
patches are ``array<int>`` (values 0..256). Raw payloads stay ``binary``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import col_

# Fixed values that must equal the reference behaviour.
PATCH_SIZE = 16        # bytes per patch
PATCH_LENGTH = 1024    # patches per training example
PAD = 256              # pad / special symbol outside the byte range
MAX_BLOCK_LENGTH = 65535
MAX_PAD_BITS = 7


def byte_at(b, i: Column) -> Column:
    """Byte ``i`` (1-based) of a binary column as int 0..255."""
    return F.conv(F.hex(F.substring(col_(b), i, 1)), 16, 10).cast("int")


def to_ints(b) -> Column:
    """binary -> array<int> of byte values.

    Lambdas here only touch their own variables: a lambda that references an
    outer expression re-evaluates it per element.
    """
    pairs = F.regexp_extract_all(F.hex(col_(b)), F.lit("([0-9A-F]{2})"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def from_ints(a) -> Column:
    """array<int> of byte values (0..255) -> binary."""
    return F.unhex(F.array_join(F.transform(col_(a), lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def pad_to(a: Column, n, value: int = PAD) -> Column:
    """Right-pad an int array with ``value`` up to length ``n`` (no-op if longer)."""
    n_c = n if isinstance(n, Column) else F.lit(n)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n_c - F.size(a), F.lit(0))))


def ext_patch(ext) -> Column:
    """First patch: UTF-8 bytes of the extension (at most 16), padded with 256."""
    return pad_to(F.slice(to_ints(F.encode(col_(ext), "UTF-8")), 1, PATCH_SIZE), PATCH_SIZE)


def n_data_patches(b) -> Column:
    return F.ceil(F.octet_length(col_(b)) / PATCH_SIZE).cast("int")


def data_patch(b, j: Column) -> Column:
    """Data patch ``j`` (0-based): 16 bytes from the payload, padded with 256."""
    return pad_to(to_ints(F.substring(col_(b), j * PATCH_SIZE + 1, PATCH_SIZE)), PATCH_SIZE)


def strip_padding(a) -> Column:
    """Drop trailing 256 symbols: slice up to the last element that is not 256."""
    arr = col_(a)
    rev_idx = F.filter(F.transform(F.reverse(arr), lambda x, i: F.when(x != PAD, i)), lambda i: i.isNotNull())
    trailing = F.coalesce(F.try_element_at(rev_idx, F.lit(1)), F.size(arr))
    keep = F.size(arr) - trailing
    return F.when(keep <= 0, F.array().cast("array<int>")).otherwise(F.slice(arr, 1, keep))


@F.arrow_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("pad", T.IntegerType())]))
def _packed(bits: pa.Array) -> pa.Array:
    data, pads = [], []
    for b in bits.to_pylist():
        if b is None:
            data.append(None)
            pads.append(None)
            continue
        pad = -len(b) % 8
        data.append(np.packbits(np.frombuffer(b"0" * pad + b.encode(), np.uint8) & 1).tobytes())
        pads.append(pad)
    return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(pads, pa.int32())], names=["data", "pad"])


@F.arrow_udf(T.StringType())
def _unpacked(data: pa.Array, pad: pa.Array) -> pa.Array:
    out = []
    for b, k in zip(data.to_pylist(), pad.to_pylist()):
        out.append(None if b is None or k is None else (np.unpackbits(np.frombuffer(b, np.uint8)) + np.uint8(48)).tobytes()[k:].decode("ascii"))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _ints_as_bits(values: pa.Array) -> pa.Array:
    out = []
    for v in values:
        out.append(None if not v.is_valid else (np.unpackbits(v.values.to_numpy(zero_copy_only=False).astype(np.uint8)) + np.uint8(48)).tobytes().decode("ascii"))
    return pa.array(out, pa.string())


def ints_to_bits(a) -> Column:
    """Bit string of an array of byte values, eight bits each."""
    return _ints_as_bits(col_(a))


def bits_to_bytes(bits) -> Column:
    """struct(data binary, pad int): left-pad the bit string with zeros to whole bytes."""
    return _packed(col_(bits))


def bytes_to_bits(b, pad) -> Column:
    """Bit string of the bytes without the leading ``pad`` bits."""
    return _unpacked(col_(b), col_(pad))


def shift_right(a) -> Column:
    """Each byte >> 1."""
    return F.transform(col_(a), lambda x: F.shiftright(x, 1))


def mask_msb(a) -> Column:
    """Bytes above 127 lose their top bit; ASCII bytes are kept."""
    return F.transform(col_(a), lambda x: F.when(x > 127, x.bitwiseAND(0x7F)).otherwise(x))


def count_non_ascii(a) -> Column:
    return F.size(F.filter(col_(a), lambda x: x > 127))


def block_blob(pad, length, payload) -> Column:
    """1 byte pad bits, 2 bytes big-endian length, payload."""
    hdr = F.concat(F.lpad(F.hex(col_(pad)), 2, "0"), F.lpad(F.hex(col_(length)), 4, "0"))
    return F.concat(F.unhex(hdr), col_(payload))


def block_status(pad, length, payload) -> Column:
    """'ok', or why the block would be rejected (pad 0..7, length 0..65535, payload present)."""
    p, n = col_(pad), col_(length)
    return (F.when(col_(payload).isNull(), F.lit("no_payload"))
            .when((p < 0) | (p > MAX_PAD_BITS), F.lit("bad_pad"))
            .when((n < 0) | (n > MAX_BLOCK_LENGTH), F.lit("bad_length"))
            .otherwise(F.lit("ok")))


def read_block(blob) -> Column:
    """struct(pad, length, payload) from a block blob; empty blobs give NULLs."""
    b = col_(blob)
    ok = F.octet_length(b) >= 3
    pad = byte_at(b, F.lit(1))
    length = byte_at(b, F.lit(2)) * 256 + byte_at(b, F.lit(3))
    payload = F.substring(b, 4, 1 << 30)
    return F.when(ok, F.struct(pad.alias("pad"), length.alias("length"), payload.alias("payload")))


def runs(ends: np.ndarray, most: int):
    """(lo, hi) of consecutive entries with at most ``most`` in all, given running totals; a larger one stands alone."""
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])
