import re

from tessera.llm import licenses as L
from tessera.llm.common import prepare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text):
    w = tokens(text)
    hits, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


CASES = [None, "", "Released under the MIT License.", "CC BY-NC 4.0 cc-by-nc CC BY NC", "under the mit", "licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "é under THE mit licenseé", "the " * 50000 + "under the MIT license",
         "Redistribution and use in source and binary forms, with or without modification, are permitted", "nc by cc nc cc by", "mozilla public license"]


def test_equals_brute_force(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(CASES + CASES)], "doc_id long, text string, license_ string, n_words int")
    got = L.scan(df).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        x = r.license
        assert (x.n_words, x.n_base, x.first_word, x.last_word, ",".join(x.base_labels)) == brute(r.text)
        assert set(x.base_labels) <= set(x.labels) and 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)
    labels = {r.doc_id: r.license.labels for r in got}
    assert labels[6] == ["gpl-3"] and labels[9] == ["bsd"] and labels[2] == ["mit"] and labels[4] == [] and labels[0] == []
    assert L.scan(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_license_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert ("gpl-3" in r.labels.split(",")) == ("GNU General Public License, version 3" in texts[r.doc_id])
