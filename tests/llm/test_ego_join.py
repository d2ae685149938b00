"""Epsilon grid order join against brute force."""

import duckdb
import numpy as np
import pytest

from tessera.llm import ego_join
from tessera.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node long, seg int, copies string, vector string, id int, `first` int"


def brute(rows, threshold=0.98):
    usable = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    xs = [np.array(v, np.float32).astype(float) if ok else None for (_, v, _), ok in zip(rows, usable)]
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(xs[i]) == len(xs[j]):
                a, b = xs[i] / np.abs(xs[i]).max(), xs[j] / np.abs(xs[j]).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(map(repr, out))


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, "c", "v", 3, 4) for r in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in ego_join.near_duplicates(df, **how).collect())


def clustered(rng, n, dims, spread):
    centres = rng.normal(size=(max(1, n // 12), dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * spread
    return [list(map(float, v)) for v in x * rng.uniform(0.01, 100, (n, 1))]


@pytest.mark.parametrize("segment", [16, 2048])
def test_clusters(spark, segment):
    rng = np.random.default_rng(3)
    rows = [(i, v, int(rng.integers(0, 3))) for i, v in enumerate(clustered(rng, 700, 12, 0.13))]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(300)]            # copies: almost a third
    want = brute(rows)
    assert run(spark, rows, segment=segment) == want
    assert sum("True" in w for w in want) < 600


def test_hot_neighbourhood(spark):
    """A third of the vectors within reach of one another, none equal."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=16)
    rows = [(i, list(map(float, c + rng.normal(size=16) * 0.08)), 1) for i in range(250)]
    rows += [(i, v, int(i % 4)) for i, v in enumerate(clustered(rng, 400, 16, 0.3), 250)]
    assert run(spark, rows, segment=32) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [0.0] * 3, 1),
            (9, [nan, 1.0, 2.0], 1), (10, [inf, 1.0, 2.0], 1), (11, [None, 1.0, 2.0], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [1e-30, 2e-30, 3e-30], 1),
            (15, [1e30, 2e30, 3e30], 1), (16, [-0.0, 1.0, 0.0], 1), (17, [0.0, 1.0, -0.0], 1), (None, [5.0, -1.0, 0.0], 3), (None, [5.0, -1.0, 0.0], 3), (18, [1.0, 2.0, 3.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and len(run(spark, [(1, None, 1)])) == 1


def test_distant_blocks_are_skipped():
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(size=(4096, 8)).astype(np.float32), axis=0)
    x[:, 0] *= 30
    axes = np.eye(8)[:, :3]
    side = ego_join._Side(x.tobytes(), len(x), "float32", axes)
    p, q = ego_join.join_sequences(side, side, True, 0.98)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.argwhere(np.triu(u @ u.T >= 0.98, 1))
    assert sorted(zip(p.tolist(), q.tolist())) == [tuple(r) for r in want.tolist()]


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    found = con.sql(ORACLE["op13_embedding_near_dedup"])
    cols, want = found.columns, found.fetchall()
    got = QUERIES["op13_embedding_near_dedup"](spark, "/root/testdata/sf0.001").select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
