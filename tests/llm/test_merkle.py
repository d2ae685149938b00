"""Merkle manifest against a recursive brute force."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.queries import ORACLE, QUERIES


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H("".join(x[i:i + 8])) for i in range(0, len(x), 8)])
    return levels


def path(levels, i):
    out = []
    for x in levels[:-1]:
        lo = i // 8 * 8
        out.append((x[lo:i], x[i + 1:lo + 8]))
        i //= 8
    return out


def brute(docs):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    by, order = {}, {}
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        by[lang], order[lang] = tree([leaf(d) for d in own]), own
    top = tree([by[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, d in enumerate(order[lang]):
            steps = path(by[lang], i) + path(top, k)
            seen = d
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None:
                seen = (*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4]))
            node = leaf(seen)
            for a, b in steps:
                node = H("".join(a) + node + "".join(b))
            out.append((d[0], leaf(d), by[lang][-1][0], top[-1][0], H("".join(x for a, b in steps for x in (*a, *b))), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, node string, steps int, `root` string, row int, name string, seen string"


def run(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, "x", 2, "y", 3, "z", "s") for d in docs], SCHEMA)
    text = F.col("text")
    found = merkle.manifest(df, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lowered(text)).otherwise(text), **how)
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("steps"), merkle.folded(F.col("seen"), "steps"),
                                           merkle.folded(F.col("seen"), "steps") == F.col("root")).collect()]


def docs_of(n_by_lang):
    out, i = [], 0
    for lang, n in n_by_lang.items():
        for _ in range(n):
            i += 1
            out.append((i * 7919 % 100003, None if i % 5 == 0 else "src", lang, None if i % 7 == 0 else i, None if i % 11 == 0 else f"Text É {i} Ä" * (i % 4)))
    return out


def test_sizes_of_trees(spark):
    docs = docs_of({None: 1, "a": 8, "b": 9, "c": 64, "d": 65, "é": 7, "": 2, "e": 130, "f": 513})
    docs += [docs[-1]] * 3 + [(None, "s", "a", 1, "N"), (None, "s", "a", 1, "N"), (docs[5][0], "other", docs[5][2], 1, "Same id"), (500000, "s", "long", 3, "LONG text " * 200000)]
    want = brute(docs)
    for levels in (1, 2, 4):       # blocks of 8, 64 and 4096 leaves: one result
        got = run(spark, docs, levels=levels)
        assert sorted(map(repr, got)) == sorted(map(repr, want)), levels
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_one_id_and_one_row_on_a_third(spark):
    docs = docs_of({"a": 300}) + [(5, "s", "a", 1, "Copy")] * 200 + [(6, "s", "b", 1, f"T{i}") for i in range(100)]
    assert sorted(map(repr, run(spark, docs, levels=2))) == sorted(map(repr, brute(docs)))


def test_many_languages(spark):
    docs = docs_of({f"l{i}": 1 + i % 3 for i in range(70)})
    assert sorted(map(repr, run(spark, docs, levels=1))) == sorted(map(repr, brute(docs)))


def test_empty(spark):
    assert run(spark, []) == []


def test_witnesses_grow_with_the_stream():
    app = merkle.Append()
    for i in range(8):
        assert all(w == [] for w in app.witness)
        app.leaf(str(i))
    assert all(len(w) == 1 for w in app.witness) and app.witness[2] == [("01", "34567")]
    app.leaf("8")
    assert app.witness[8] == [] and app.close(None) == H(H("01234567") + H("8"))
    assert app.witness[8] == [("", ""), (H("01234567"), "")]


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    found = con.sql(ORACLE["op12_merkle_manifest"])
    cols, want = found.columns, found.fetchall()
    got = QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
