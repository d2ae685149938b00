"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import duckdb

from tessera.llm import spelling
from tessera.llm.queries import ORACLE, QUERIES


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute(docs):
    n = Counter()
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}
    for doc_id, text in docs:
        run = ""
        for ch in (text or "") + " ":
            if ch in letters:
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                w, run = run, ""
                h = zlib.crc32(f"{doc_id}:{w}".encode())
                if doc_id is not None and h % 97 == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
                if len(w) >= 5:
                    n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    out = {}
    for w, c in n.items():
        ws = [v for v in n if near(w, v)]
        top = min(ws, key=lambda v: (-n[v], v), default=None)
        form = top if top is not None and n[top] >= 2 * c else None
        out[w] = [c, len(ws), form, n[form] if form else None]
    res = {}
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        res[w] = (*out[w], r)
    return res


def result(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


SCHEMA = "doc_id long, text string, word string, n int, form string, root string, `key` int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "w", 1, "f", "r", 2) for i, t in docs], SCHEMA)


def test_random_words(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaaaa", "ababababa", "abababab"]
    words = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdX") + w[i:], w[:i] + rng.choice("abcdX") + w[i + 1:]]))
    weights = [rng.choice([3, 3, 7, 20]) for _ in words]
    docs = [(d, " ".join(rng.choices(words, weights, k=60)) + rng.choice(["", "1×-Straße_ABCDE"])) for d in range(150)]
    docs += [(None, "abcdef " * 9), (None, None), (7, ""), (7, "abcdef"), (8, "zzzzz" * 30000), docs[3], docs[3]]
    got = result(spelling.variants(frame(spark, docs)))
    want = brute(docs)
    assert got == want
    assert sum(v[1] for v in want.values()) > 200 and any(want[v[2]][2] for v in want.values() if v[2])


def test_one_gram_everywhere(spark):
    """A third of the words share their rarest gram and place."""
    rng = random.Random(6)
    words = ["qz" + "".join(rng.choice("ab") for _ in range(5)) for _ in range(60)] + ["".join(rng.choice("abcd") for _ in range(7)) for _ in range(120)]
    docs = [(d, " ".join(words)) for d in range(4)]
    assert result(spelling.variants(frame(spark, docs))) == brute(docs)


def test_pivots_are_disjoint_and_rare():
    count = {"ab": 9, "bc": 1, "cd": 2, "de": 8, "ef": 7}
    rank = {g: i for i, g in enumerate(sorted(count, key=count.get))}
    assert spelling.prefix_and_pivots("abcdef", rank, count) == ([1, 2, 4], [1, 4], 2)


def test_empty(spark):
    assert spelling.variants(frame(spark, []).where("false")).count() == 0
    assert spelling.variants(frame(spark, [(1, "a b c"), (2, None)])).count() == 0


def test_oracle(spark):
    name = "op11_spelling_variants"
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    found = con.sql(ORACLE[name])
    cols, want = found.columns, found.fetchall()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
