import random

import pytest
import xxhash

from tessera.llm import simhash as S
from tessera.llm.common import prepare


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, near):
    ids = list(range(len(pairs)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i
    for i in range(len(pairs)):
        for j in range(i):
            if near(pairs[i][1], pairs[j][1]):
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(pairs)):
        out.setdefault(find(i), []).append(pairs[i][0])
    return [min((x for x in out[find(i)] if x is not None), default=None) for i in range(len(pairs))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rng.choice(["The", "a", "é", "x\ty", "Z\n"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == brute_fp(t)


def test_links_equal_brute_force(spark):
    prepare(spark)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(10):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    dense = base[0] & ~0xFFFF
    fps |= {dense | x for x in range(300)}                     # one long posting list
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(df)).collect()}
    sgn = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(list(zip(sgn, fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    assert [roots.get(s, s) for s in sgn] == want


def test_rows_ties_nulls_and_clashing_columns(spark):
    prepare(spark)
    texts = ["a b c d e f g", "a b c d e f g", None, "", "  \n", "one two", "ONE two", "x" * 100000]
    rows = [(i, t, 7, "z") for i, t in enumerate(texts)] + [(0, texts[0], 7, "z"), (None, "alone words here now", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, `group` string")
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(df).collect()]
    fps = [(i, brute_fp(t)) for i, t, *_ in rows]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(i, f, c) for (i, f), c in zip(fps, comp)], key=key)
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fp(r.text)) for r in docs]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(fps, comp)}
