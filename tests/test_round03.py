"""Findings of round 3: steps that scale, with the results of a plain computation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import bytes as B
from tessera.operators import retrieval as R
from tessera.sources import files as FS


def brute(rows, queries, k):
    out = []
    unit = lambda ws: {w: ws.count(w) / sum(ws.count(x) ** 2 for x in set(ws)) ** 0.5 for w in set(ws)}
    vec = {i: unit(t.lower().split()) for i, t in rows if t}
    for qid, text in queries:
        q = unit(text.lower().split())
        s = [(-round(sum(q[w] * v.get(w, 0) for w in q), 6), i) for i, v in vec.items()]
        out += [(qid, r + 1, i, -x) for r, (x, i) in enumerate(sorted(p for p in s if p[0] < 0)[:k])]
    return sorted(out)


def test_sparse_search_of_common_and_rare_words(spark, monkeypatch):
    """The matrix part and the lists give the brute-force hits, in slices of any size."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(300)] + [(900, ""), (901, None)]
    queries = [(i, " ".join(word() for _ in range(8))) for i in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].split() if r[1] else r[1] and [] for r in rows], pa.list_(pa.string()))],
                                       names=["cid", "words"])
    weights = [(i, t, c / sum(text.split().count(x) ** 2 for x in set(text.split())) ** 0.5)
               for i, text in queries for t in set(text.split()) for c in [text.split().count(t)]]
    ids, terms, q, w, first = R._query_terms(weights)
    want = brute(rows, queries, 3)
    for common, cells, entries in ((256, 1 << 24, 1 << 20), (5, 700, 10), (0, 1 << 24, 1)):
        monkeypatch.setattr(R, "COMMON_TERMS", common)
        monkeypatch.setattr(R, "MAX_SCORE_CELLS", cells)
        monkeypatch.setattr(R, "LIST_ENTRIES", entries)
        got = pa.Table.from_batches(list(R._sparse_scores([batch], ids, terms, q, w, first, 3)))
        rank = {}
        out = []
        for qid, s, cid in sorted((r["qid"], -r["score"], r["cid"]) for r in got.to_pylist()):
            rank[qid] = rank.get(qid, 0) + 1
            out.append((qid, rank[qid], cid, -s))
        assert [x[:3] for x in sorted(out)] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in sorted(out)], [x[3] for x in want], atol=2e-6)


def test_bits_are_made_once_per_payload(spark):
    """no expression runs per byte and again for each column that uses it."""
    df = spark.createDataFrame([(1, "0000"), (2, ""), (3, None), (4, "1" * 1001), (5, "10" * 40)], "id long, bits string")
    s = B.bits_to_bytes("bits")
    x = df.select("id", "bits", s["data"].alias("data"), s["pad"].alias("pad"), B.bytes_to_bits(s["data"], s["pad"]).alias("back"))
    got = {r.id: r for r in x.collect()}
    assert all(got[i].back == got[i].bits for i in got) and (bytes(got[4].data)[:1], got[4].pad) == (b"\x01", 7)
    assert got[3].data is None and got[3].pad is None and got[2].data == b""
    v = spark.createDataFrame([(1, [0, 255, 5]), (2, []), (3, None)], "id long, v array<int>")
    assert [r.b for r in v.select("id", B.ints_to_bits("v").alias("b")).orderBy("id").collect()] == ["000000001111111100000101", "", None]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "regexp_extract_all" not in plan


def test_small_files_share_tasks(spark, tmp_path):
    """a task reads many small files."""
    for i in range(100):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    t = FS.read_text_files(spark, str(tmp_path), glob="*.txt")
    assert t.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and t.agg(F.sum(F.length("text"))).first()[0] == 4950
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b"


def test_batches_are_bounded_by_bytes(spark):
    """what a worker gets at once does not grow with the rows' size."""
    big = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("s"))
    sizes = big.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= 12 << 20 and sum(r.n for r in sizes) >= 40 << 20
