import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup as D
from tessera.llm.common import new_dir, prepare, read


def brute(docs, length, keep_first=False):
    seen = {}
    raw = [(t or "").encode() for _, t in docs]
    for d, x in enumerate(raw):
        for s in range(len(x) - length + 1):
            seen.setdefault(x[s:s + length], []).append((d, s))
    out = []
    for d, x in enumerate(raw):
        cover = bytearray(len(x))
        for s in range(len(x) - length + 1):
            where = seen[x[s:s + length]]
            if where[0] != (d, s) if keep_first else len(where) > 1:
                cover[s:s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(x, cover) if not m)
        spans = sum(1 for i, m in enumerate(cover) if m and (i == 0 or not cover[i - 1]))
        out.append((docs[d][0], len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed, n=60, length=40):
    rng = random.Random(seed)
    rand = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passage, long = rand(3 * length), rand(20 * length)
    docs = [(i, rand(rng.randrange(6 * length))) for i in range(n)]
    for i in range(0, n, 4):
        t = docs[i][1]
        k = rng.randrange(len(t) + 1)
        docs[i] = (i, t[:k] + passage + t[k:])
    for i in range(1, n, 5):
        k = rng.randrange(len(long))
        docs[i] = (i, long[:k] + rng.choice("xyz") + long[k + 1:])
    return docs + [(200, None), (201, ""), (202, long), (203, long), (203, long), (204, "ab " * 300), (207, "ab " * 200), (208, " Is onhe." * 9000), (205, "q" * 1000), (206, passage[:length - 1]), (None, passage + "end")]


def table(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, kind string, place int").repartition(3).checkpoint()


def test_anchors_depend_on_content_only():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    p, lo, hi = D.anchors(text, 40, 20)
    assert lo[0] == 0 and hi[-1] == len(text) - 40 and (lo[1:] == hi[:-1] + 1).all()
    assert ((p >= hi) & (p <= lo + 20)).all()
    owner = {s: a - s for a, b, c in zip(p, lo, hi) for s in range(b, c + 1)}
    for s in (0, 5, 700, 2000):
        q, a, b = D.anchors(text[s:s + 40], 40, 20)
        assert len(q) == 1 and q[0] == owner[s]


def test_segments_give_the_same_owners(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    own = lambda: {s: a for a, b, c in zip(*D.anchors(text, 40, 20)) for s in range(b, c + 1)}
    whole = own()
    monkeypatch.setattr(D, "SEGMENT", 333)
    assert own() == whole


def test_equals_brute_force(spark):
    prepare(spark)
    for seed in (1, 2):
        docs = corpus(seed)
        assert rows(D.remove(table(spark, docs), length=40, gram=20, keep_first=False)) == sorted(brute(docs, 40), key=repr)


def test_keep_first_leaves_one_copy(spark):
    prepare(spark)
    docs = corpus(3)
    df = table(spark, docs).coalesce(1).sortWithinPartitions("doc_id").checkpoint()
    order = [(r.doc_id, r.text) for r in df.collect()]
    assert rows(D.remove(df, length=40, gram=20)) == sorted(brute(order, 40, True), key=repr)
    kept = D.remove(df, length=40, gram=20, keep_bytes=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def resolve(groups, length, sizes):
    """Run the streaming comparison over batches of the given sizes and finish named rows."""
    import pyarrow as pa
    flat = [(g, 0, i << 32, len(c) - length, c) for g, cs in groups for i, c in cs]
    batches, at = [], 0
    while at < len(flat):
        part = flat[at:at + next(sizes)]
        cols = list(zip(*part))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                                  names=["gram", "block", "place", "reach", "bytes"]))
        at += len(part)
    got, named = set(), []
    for b in D._resolve(length)(iter(batches)):
        for r in b.to_pylist():
            if r["kind"] == D.NAME:
                named.append(r)
            else:
                got |= {(r["place"] >> 32, (r["place"] & 0xFFFFFFFF) + k, r["kind"]) for k in range(r["reach"] + 1)}
    if named:
        t = pa.Table.from_pylist(named).sort_by([(c, "ascending") for c in ("name", "name2", "block", "place")])
        for b in D._named(iter(t.to_batches(max_chunksize=7))):
            got |= {(r["place"] >> 32, r["place"] & 0xFFFFFFFF, r["kind"]) for r in b.to_pylist()}
    return got, bool(named)


def test_groups_past_the_bound_go_by_name(monkeypatch):
    rng = random.Random(4)
    length = 8
    groups, n = [], 0
    for g in range(30):
        k = 60 if g in (3, 11, 29) else rng.randrange(1, 8)
        cs = []
        for _ in range(k):
            cs.append((n, bytes(rng.choice(b"ab") for _ in range(4)) + bytes([g + 1]) * 4 + bytes(rng.choice(b"ab") for _ in range(4))))
            n += 1
        groups.append((g, cs))
    count = {}
    for _, cs in groups:
        for i, c in cs:
            for s in range(len(c) - length + 1):
                count.setdefault(c[s:s + length], []).append((i, s))
    want = {(i, s, k) for ps in count.values() for j, (i, s) in enumerate(ps) for k, on in ((D.EARLIER, j > 0), (D.LATER, j + 1 < len(ps))) if on}
    # A first copy by name says only that later ones exist; members in between are EARLIER.
    removed = lambda x: {(i, s) for i, s, _ in x}
    first = lambda x: {(i, s) for i, s, k in x if k == D.EARLIER}
    for bound, batch in ((1000, 5), (20, 5), (20, 1000), (20, 1)):
        monkeypatch.setattr(D, "GROUP_CONTEXTS", bound)
        monkeypatch.setattr(D, "BATCH_CONTEXTS", 10)
        got, named = resolve(groups, length, iter(lambda: batch, 0))
        assert removed(got) == removed(want) and first(got) == first(want) and named == (bound == 20)


def test_settle_streams_any_batching():
    import pyarrow as pa
    rng = random.Random(5)
    rows = sorted((rng.randrange(12), rng.randrange(3), 0, i, 5) for i in range(120))
    again = (99, 1, 0, 500, 5 | D.AGAIN)
    settled = (40, 7, 0, 600, -1 - 77)
    rows = sorted([*rows, again, settled])
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.int32(),))]
    t = pa.table(cols, names=["gram", "context", "block", "place", "reach"])
    results = []
    for size in (1, 2, 7, 1000):
        results.append(sorted((r["place"], r["kind"]) for b in D._settle(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist()))
    assert all(r == results[0] for r in results)
    by = {}
    for g, c, _, p, r in rows:
        if r >= 0:
            by.setdefault(g, {}).setdefault(c, []).append(p)
    want = [(500, D.LATER), (600, D.EARLIER)]
    for classes in by.values():
        for ps in classes.values():
            want += [(p, D.EARLIER) for p in ps[1:]] + ([(ps[0], D.LATER)] if len(ps) > 1 else []) + ([(ps[0], D.ASK)] if len(classes) > 1 else [])
    assert results[0] == sorted(want)


def test_equal_contexts_of_a_block_are_combined():
    text = b"start of it " + b" Is onhe." * 30000 + b" end"
    p, lo, hi = D.anchors(text, 40, 20)
    gram = np.array([hash(text[a:a + 20]) for a in p])
    context = np.array([hash(text[b:c + 40]) for b, c in zip(lo, hi)])
    first, again, start, more = D._combine(gram, context, lo, hi - lo)
    assert first.sum() < 60 and len(start) < 60 and more.max() < 1 << 16
    got = sorted((s, s + m) for s, m in zip(start.tolist(), more.tolist()))
    want = sorted((a, b) for a, b, f in zip(lo.tolist(), hi.tolist(), first) if not f)
    assert sum(b - a + 1 for a, b in got) == sum(b - a + 1 for a, b in want)
    assert {x for a, b in got for x in (a, b)} <= {x for a, b in want for x in (a, b)}


def test_empty_table(spark):
    prepare(spark)
    assert D.remove(table(spark, corpus(1)).limit(0).checkpoint()).collect() == []


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    got = QUERIES["op9_suffix_array_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute(docs, 400))


def test_rows_dealt_anew_between_passes(spark):
    """Other file splits when the result is read than when the matches were found."""
    prepare(spark)
    path = new_dir(spark, "test")
    table(spark, corpus(3)).repartition(12, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    run = lambda: D.remove(docs, length=40, gram=20, keep_first=False)
    want, out = rows(run()), run()
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("2048", "1")):
            spark.conf.set(k, v)
        assert rows(out) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
