"""Table functions for SQL: chunks, patches and trace records of a column, for use in LATERAL joins.

    register(spark)
    spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk_text FROM documents d, LATERAL chunks_of(d.text, 256, 32) c")

They are SQL functions over one generator each, so they run on the JVM and the planner turns the lateral join into a
plain generator (no join, no shuffle). ``transform(array(x), v -> ...)[0]`` binds a value once for the inner lambdas.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.bytes import PATCH_SIZE
from tessera.functions.text import WORD_SPLIT
from tessera.operators.patches import TRACE_MEMORY_BYTES, TRACE_RECORD_BYTES

_SPLIT = WORD_SPLIT.replace("\\", "\\\\")


def _bound(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _counted(n: str, first: int) -> str:
    """first, first + 1, ... (n numbers)."""
    return f"IF({n} > 0, sequence({first}, {n} + {first - 1}), CAST(array() AS ARRAY<INT>))"


def _byte(k: int) -> str:
    return f"CAST(conv(hex(substring(b, {TRACE_MEMORY_BYTES} + no * {TRACE_RECORD_BYTES} + {k}, 1)), 16, 10) AS INT)"


_WORDS = f"filter(split(body, '{_SPLIT}'), x -> x <> '')"
_STARTS = "IF(size(w) > 0, sequence(0, size(w) - 1, size - overlap), CAST(array() AS ARRAY<INT>))"
_PATCHES = f"CAST(ceil(octet_length(b) / {PATCH_SIZE}) AS INT)"
_RECORDS = f"CAST(floor((octet_length(b) - {TRACE_MEMORY_BYTES}) / {TRACE_RECORD_BYTES}) AS INT)"

FUNCTIONS = {
    "chunks_of": "(body STRING, size INT, overlap INT) RETURNS TABLE (chunk_no INT, chunk_text STRING) RETURN SELECT pos, col FROM posexplode("
                 + _bound(_WORDS, "w", f"transform({_STARTS}, i -> array_join(slice(w, i + 1, size), ' '))") + ")",
    "patches_of": "(content BINARY) RETURNS TABLE (patch_no INT, patch BINARY) RETURN SELECT pos + 1, col FROM posexplode("
                  + _bound("content", "b", f"transform({_counted(_PATCHES, 1)}, no -> substring(b, (no - 1) * {PATCH_SIZE} + 1, {PATCH_SIZE}))") + ")",
    "records_of": "(blob BINARY) RETURNS TABLE (step INT, pc INT, acc INT, ir ARRAY<INT>, registers ARRAY<INT>)"
                  " RETURN SELECT pos, col.pc, col.acc, col.ir, col.registers FROM posexplode("
                  + _bound("blob", "b", f"transform({_counted(_RECORDS, 0)}, no -> named_struct('pc', {_byte(1)}, 'acc', {_byte(2)}, "
                                        f"'ir', array({', '.join(_byte(3 + i) for i in range(4))}), 'registers', array({', '.join(_byte(7 + i) for i in range(10))})))") + ")",
}


def register(spark: SparkSession) -> None:
    """Define the functions in this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
