import itertools
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import quality as Q
from tessera.llm.common import prepare


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(wins)
    hit = {j for i, w in enumerate(wins) if many[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


CASES = [None, "", " \n\t", "a b c", "a b c a b c", "é ü　x y\x0b#|<é>\n\né ü\nx\r\n", "w " * 5000, "Grüße an alle. " * 40, "x" * 200000]


def test_counts_equal_brute_force():
    rng = random.Random(3)
    more = [" ".join(rng.choice("aé b\nc# d\te".split(" ")) for _ in range(rng.randrange(200))) for _ in range(50)]
    for t in CASES + more:
        assert Q.base_counts((t or "").encode()) == brute(t)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(30):
        f = Q.LineField(rng.normal(size=(Q.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        s = rng.normal(size=(7, 2))
        score = lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(f.change[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert f.decode(s.tolist()) == list(best)


def test_features_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for t in CASES]
    f, lines, chars = Q.line_features(texts)
    at = 0
    for t, n in zip(texts, lines):
        g, m, c = Q.line_features([t])
        assert m.tolist() == [n] == [t.count(b"\n") + 1]
        assert np.array_equal(f[at:at + n], g) and np.array_equal(chars[at:at + n], c)
        at += n


def test_judge_edge_rows(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, t, True, 1.0) for i, t in enumerate(CASES + CASES)], "doc_id long, text string, kept boolean, content_share double")
    got = Q.judge(df, Q.LineField.fit([], [])).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        w = brute(r.text)
        assert tuple(r.quality_rules)[:5] == w
        assert r.quality_rules.base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0])
        assert r.quality_rules.kept == (not r.quality_rules.base_failed)
    assert Q.judge(df.limit(0), Q.LineField.fit([], [])).collect() == []


def test_held_out_accuracy(spark):
    """Trained on one table, judged on the labelled documents of a larger one."""
    sf = "/root/testdata"
    prepare(spark)
    d = spark.read.parquet(f"{sf}/sf0.01/documents.parquet")
    field = Q.fit(d, spark.read.parquet(f"{sf}/sf0.01/labels.parquet"))
    big = spark.read.parquet(f"{sf}/sf0.1/documents.parquet").where("doc_id >= 1000").join(spark.read.parquet(f"{sf}/sf0.1/labels.parquet"), "doc_id")
    rows = Q.judge(big.select("doc_id", "text", "quality"), field).where("not quality_rules.base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.quality_rules.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.quality_rules.kept for r in bad) >= 0.8 * len(bad)


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_quality_rules"](spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
