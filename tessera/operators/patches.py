"""Binary payloads as patch tables: explode, pad, truncate, merge, verify, trace decode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.plans.hints import bounded_broadcast
from tessera.session import stored

# Fixed values that must equal the reference behaviour.
TRACE_MEMORY_BYTES = 1024   # program memory ahead of the states
TRACE_RECORD_BYTES = 16     # PC, ACC, IR[4], registers A..J
OPCODES = ["HLT", "CLR", "INC", "DEC", "SHL", "SHR", "ROL", "ROR", "NOT", "PUSH", "POP",
           "LOADI", "SWAP", "ADD", "SUB", "MUL", "DIV", "AND", "OR", "XOR", "MOV"]   # codes 0..20
REGISTERS = ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J"]                        # codes 1..10


def to_patches(files: DataFrame, id_col: str, content: str, ext: str | None = None,
               ext_value: str | None = None) -> DataFrame:
    """(id, patch_no, patch array<int>, mask): extension patch, data patches, end patch.

    Narrow: one generator per file; every patch is a 16-byte binary slice.
    """
    e = F.col(ext) if ext else F.lit(ext_value or "")
    m = B.n_data_patches(content)
    nos = F.sequence(F.lit(0), m + 1)
    x = files.select(F.col(id_col), F.col(content).alias("_c"), e.alias("_e"), m.alias("_m"),
                     F.explode(nos).alias("patch_no"))
    patch = (F.when(F.col("patch_no") == 0, B.ext_patch("_e"))
             .when(F.col("patch_no") == F.col("_m") + 1, F.array_repeat(F.lit(B.PAD), B.PATCH_SIZE))
             .otherwise(B.data_patch("_c", F.col("patch_no") - 1)))
    return x.select(id_col, F.col("patch_no").cast("int"), patch.alias("patch"), F.lit(1).alias("mask"))


def patch_bytes(patch) -> F.Column:
    """The bytes of a patch: its symbols up to the padding."""
    return B.from_ints(F.filter(patch, lambda x: x < B.PAD))


def patch_pieces(patches: DataFrame, id_col: str, per_piece: int = 1 << 16) -> DataFrame:
    """(path, piece_no, data): the bytes of a file's data patches, ``per_piece`` patches to a piece. A file is as many
    rows as it needs; one without data patches is one empty piece."""
    at = F.greatest(F.col("patch_no") - 1, F.lit(0))
    data = F.when(F.col("patch_no") > 0, patch_bytes("patch")).otherwise(F.lit(b"").cast("binary"))
    p = patches.select(F.col(id_col).alias("path"), F.floor(at / per_piece).cast("int").alias("piece_no"), "patch_no", data.alias("_b"))
    return p.groupBy("path", "piece_no").agg(F.expr("listagg(_b) WITHIN GROUP (ORDER BY patch_no)").alias("data"))


def merge_patches(patches: DataFrame, id_col: str, drop_ends: bool = True) -> DataFrame:
    """(id, data binary): data patches in patch order, padding removed.

    Patches travel as bytes; the end patch is all padding, so it adds nothing and a file
    without data patches comes back empty. One output row per file.
    """
    keep = F.col("patch_no") > 0 if drop_ends else F.lit(True)
    p = patches.select(id_col, "patch_no", F.when(keep, patch_bytes("patch")).alias("_b"))
    return p.groupBy(id_col).agg(F.coalesce(F.expr("listagg(_b) WITHIN GROUP (ORDER BY patch_no)"), F.lit(b"").cast("binary")).alias("data"))


BLOCK, SPAN = 1 << 16, 1 << 8       # bytes under one hash: first blocks of a payload, then spans of the block that differs


def _hashes(data: str, start, size, step: int) -> F.Column:
    """SHA-256 of every ``step`` bytes of ``size`` bytes from the 0-based ``start`` on."""
    last = F.greatest(F.ceil(size / step).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col(data), (start + i * step + 1).cast("int"), step), 256))


def _first_unequal(a, b) -> F.Column:
    """0-based place of the first unequal elements, null if there are none; a missing element is unequal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.equal_null(x, y)), False)
    return F.when(at > 0, at - 1)


def verify_roundtrip(original: DataFrame, rebuilt: DataFrame, id_col: str, data: str = "data") -> DataFrame:
    """Per id: equal?, both sizes, first differing byte (1-based; NULL when equal or one side is missing).

    A tree of hashes: the sides meet with the SHA-256 of their blocks, and the first block that differs is found
    from them. Payloads that differ are narrowed to a span of that block in the same way, and only such spans (at most
    256 bytes) are compared as bytes; no payload is shuffled.
    """
    o, r = (df.select(id_col, F.col(data).alias("_d")) for df in (original, rebuilt))
    whole = lambda df, p: df.select(id_col, F.octet_length("_d").alias(f"{p}_n"), _hashes("_d", F.lit(0), F.octet_length("_d"), BLOCK).alias(f"{p}_h"))
    j = whole(o, "_o").join(whole(r, "_r"), id_col, "full_outer")
    equal = F.coalesce((F.col("_o_n") == F.col("_r_n")) & (F.col("_o_h") == F.col("_r_h")), F.lit(False))
    j = stored(j.select(id_col, equal.alias("equal"), F.col("_o_n").alias("original_bytes"), F.col("_r_n").alias("rebuilt_bytes"),
                        (F.when(~equal, _first_unequal("_o_h", "_r_h")) * BLOCK).alias("_at")), "verify-blocks")
    differ = j.where("_at is not null").select(id_col, "_at")
    if differ.isEmpty():
        return j.select(id_col, "equal", "original_bytes", "rebuilt_bytes", F.lit(None).cast("int").alias("first_diff"))
    part = lambda df, at, what: df.join(bounded_broadcast(at), id_col).select(id_col, "_at", what)
    spans = _hashes("_d", F.col("_at"), F.least(F.lit(BLOCK), F.greatest(F.octet_length("_d") - F.col("_at"), F.lit(0))), SPAN)
    near = part(o, differ, spans.alias("_a")).join(part(r, differ, spans.alias("_b")), [id_col, "_at"])
    differ = stored(near.select(id_col, (F.col("_at") + _first_unequal("_a", "_b") * SPAN).alias("_at")), "verify-spans")
    few = B.to_ints(F.substring(F.col("_d"), (F.col("_at") + 1).cast("int"), SPAN))
    last = part(o, differ, few.alias("_a")).join(part(r, differ, few.alias("_b")), [id_col, "_at"])
    found = last.select(id_col, (F.col("_at") + _first_unequal("_a", "_b") + 1).cast("int").alias("first_diff"))
    return j.join(found, id_col, "left").select(id_col, "equal", "original_bytes", "rebuilt_bytes", "first_diff")


def record_fields(blob: str) -> list:
    """Column expressions for one trace record at ``_off`` (0-based byte offset)."""
    at = lambda k: B.byte_at(blob, F.col("_off") + k + 1)
    return [at(0).alias("pc"), at(1).alias("acc"),
            F.array(*[at(2 + i) for i in range(4)]).alias("ir"),
            F.array(*[at(6 + i) for i in range(10)]).alias("registers")]


def decode_trace(traces: DataFrame, id_col: str, blob: str) -> DataFrame:
    """(id, step, pc, acc, ir, registers): fixed 16-byte records after the memory image."""
    n = F.floor((F.octet_length(blob) - TRACE_MEMORY_BYTES) / TRACE_RECORD_BYTES).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    x = traces.select(id_col, blob, F.explode(steps).alias("step"))
    x = x.withColumn("_off", F.col("step") * TRACE_RECORD_BYTES + TRACE_MEMORY_BYTES)
    return x.select(id_col, "step", *record_fields(blob))


def opcode_name(ir) -> F.Column:
    """Assembly text of an instruction [op, a1, a2, a3]: 'ADD A B', 'LOADI 7', 'HLT'.

    Unknown opcodes or registers give NULL.
    """
    ops = F.array(*[F.lit(o) for o in OPCODES])
    regs = F.array(*[F.lit(r) for r in REGISTERS])
    i = F.col(ir) if isinstance(ir, str) else ir
    op = F.try_element_at(ops, i[0] + 1)
    reg = lambda k: F.when(i[k] == 0, F.lit("")).otherwise(F.try_element_at(regs, i[k]))
    a1 = F.when(op == "LOADI", i[1].cast("string")).otherwise(reg(1))
    parts = F.array(op, a1, reg(2), reg(3))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None).cast("string")).otherwise(
        F.trim(F.array_join(parts, " ")).alias("asm"))
