import hashlib
import random
import re

from tessera.llm import decontam as D
from tessera.llm.common import prepare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = tokens(t)
        for j in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[j:j + 10]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = tokens(t)
        hit, names = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                found = wins.get(tuple(w[j:j + n]))
                if found:
                    hit |= set(range(j, j + n))
                    names |= found
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def tables(seed=5):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "é", "rare1", "rare2", "x", "Y", "z9", "w"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(90, None), (91, items[5][1]), (5, items[5][1]), (92, "?!")]
    docs = []
    for d in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(80)))
        if d % 3 == 0:
            t += ", " + rng.choice(items)[1].__str__().upper() + ". " + t[:20]
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "filler " * 20000 + (items[6][1] or "")), (103, docs[0][1]), (103, docs[0][1])]
    return docs, items


def rows(df):
    return sorted(((r.row, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), r["items"]) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "c", 3) for d, t in docs], "doc_id long, text string, row string, items int"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_equals_brute_force(spark):
    prepare(spark)
    docs, items = tables()
    d, b = frames(spark, docs, items)
    assert rows(D.find(d, b)) == brute(docs, items)


def test_blocks_of_items_give_the_same_rows(spark):
    prepare(spark)
    docs, items = tables(6)
    docs = docs[:-1]
    d, b = frames(spark, docs, items)
    assert rows(D.find(d, b, block_bytes=400)) == brute(docs, items)


def test_empty_tables(spark):
    prepare(spark)
    docs, items = tables(7)
    d, b = frames(spark, docs, items)
    assert rows(D.find(d.limit(0), b)) == []
    assert rows(D.find(d, b.limit(0))) == brute(docs, [])


def test_proximity(spark):
    prepare(spark)
    d, b = frames(spark, [(1, "alpha so beta and gamma"), (2, "alpha " + "pad " * 30 + "beta gamma")], [(7, "alpha beta gamma")])
    assert {r.row: r.near_items for r in D.find(d, b).collect()} == {1: ["7"], 2: []}


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    pick = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    want = brute(pick("documents", "doc_id"), pick("benchmark", "item_id"))
    got = QUERIES["op4_benchmark_decontamination"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == sorted(
        ((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want), key=repr)


def brute_near(docs, items, slop=5):
    out = []
    for d, t in docs:
        text, names = tokens(t), set()
        at = {}
        for p, x in enumerate(text):
            at.setdefault(x, []).append(p)
        for i, it in items:
            w = tokens(it)
            for j in range(max(1, len(w) - 9)) if w else ():
                win = w[j:j + 10]
                need = -(-len(win) * 4 // 5)
                if any(sum(any(abs(p - s - k) <= slop for p in at.get(x, ())) for k, x in enumerate(win)) >= need
                       for s in range(-20, len(text) + 20)):
                    names.add(str(i))
                    break
        out.append((d, sorted(names)))
    return sorted(out, key=repr)


def near(df):
    return sorted(((r.row, r.near_items) for r in df.collect()), key=repr)


def test_proximity_equals_brute_force(spark):
    prepare(spark)
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 2, 3, 5, 9, 10, 12, 25])))) for i in range(14)] + [(51, "only here")]
    docs = []
    for d in range(60):
        t = rng.choice(items)[1].split() if d % 2 and d else []
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = f"new{d}"
        for _ in range(rng.randrange(3)):
            t.insert(rng.randrange(len(t) + 1), "pad")
        docs.append((d, " ".join(say(rng.randrange(12)) + t + say(rng.randrange(12)))) if d else (d, None))
    d, b = frames(spark, docs, items + [(50, None)])
    want = brute_near(docs, items)
    assert sum(map(len, (n for _, n in want))) > 30
    assert near(D.find(d, b)) == want
    assert near(D.find(d, b, block_bytes=100)) == want


def test_proximity_with_a_word_replaced_and_in_part(spark):
    prepare(spark)
    item = "k1 k2 k3 k4 k5 zebra k7 k8 k9 k10"
    d, b = frames(spark, [(1, "so " + item.replace("zebra", "horse") + " so"), (2, "k1 k2 k3 q1 q2 q3 q4 q5 q6 q7"), (3, "l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 more")],
                  [(7, item), (8, "x1 x2 x3 x4 " + " ".join(f"l{k}" for k in range(1, 11)) + " x5")])
    assert near(D.find(d, b)) == [(1, ["7"]), (2, []), (3, ["8"])]


def test_proximity_stays_in_one_document(spark):
    prepare(spark)
    d, b = frames(spark, [(1, "alpha beta"), (2, "gamma delta")], [(7, "alpha beta gamma")])
    assert near(D.find(d.coalesce(1), b)) == [(1, []), (2, [])]


def test_blocks_of_items_keep_rows_apart(spark):
    """Equal rows, rows that share an id, and null ids, each a row of its own in both forms."""
    prepare(spark)
    docs, items = tables(6)
    docs += [(103, docs[3][1]), (None, docs[0][1]), (None, docs[3][1]), (None, docs[3][1]), (None, None)]
    d, b = frames(spark, docs, items)
    whole, blocks = D.find(d, b), D.find(d, b, block_bytes=400)
    assert whole.columns == blocks.columns
    assert rows(blocks) == rows(whole) == brute(docs, items)
    assert near(blocks) == near(whole)
