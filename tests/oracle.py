"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle.py [sf_dir] [key ...]
Compares column names, row counts and the sorted multiset of rows.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    if isinstance(v, bool):
        return int(v)
    return v


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
                  "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "tinyint": "TINYINT"}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<") and spark_type.endswith(">"):
        return duck_type(spark_type[6:-1]) + "[]"
    return _SPARK_TO_DUCK.get(spark_type, spark_type.upper())


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    ts = time.time() - t0
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    td = time.time() - t1
    res = dict(key=key, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2), duck_s=round(td, 2))
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return res
    stypes = {f.name: duck_type(f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {c: str(t) for c, t in zip(dcols, rel.types)}
    tdiff = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    if tdiff:
        res["type_diff"] = tdiff
    a, b = canon(scols, srows), canon(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res.update(ok=False, why=f"values differ, e.g. {diff}" if len(a) == len(b) else "row count")
        return res
    res.update(ok=True)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from tessera.session import get_session
    import __spark_entry__ as E
    spark = get_session(partitions=8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys or sorted(qs):
        try:
            r = check(spark, con, sf_dir, k, qs[k], orc.get(k))
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, why=f"{type(e).__name__}: {str(e)[:300]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
