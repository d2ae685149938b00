import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import binary_output as B
from tessera.llm import packing as K
from tessera.llm.common import new_dir, prepare
from tessera.llm.tokens import Encoder

TEXTS = [None, "", "a", "Hello world.\nNew  line\t tab \r\n x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "x<|endoftext| >", "<|endoftext|> é ü  　z  ", "  lead", "it's we'll 's ' s''s", "日本 語\x1c x\x85y",
         "token " * 3000, "x" * 5000, "\n\n\n", " \n a \n\n b"]


def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(8)
    ref, enc = reference(), Encoder(P.path("byte_bpe_50k.json"))
    alphabet = ["a", "<|endoftext|>", "The", "é", " ", "  ", "\n", "\t", ".", "'s", "12", " ", "\r", "​", "語", "!", "ß"]
    for t in TEXTS[1:] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref(t), repr(t)


def test_words_go_to_the_model_alone():
    """The library's regular expressions see no word of letters; ids are the same."""
    enc = Encoder(P.path("byte_bpe_50k.json"))
    seen, library = [], enc._tokenizer

    class Seen:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts[0].split("\n"))
            return library.encode_batch_fast(texts, **options)

    enc._tokenizer = Seen()
    words = ["plain", "Größe", "\u00c0\u00d6\u00d8\u00f6\u00f8\u00ff\u0100\u01c3\u024f", "don't", "a-b", "x1", "7\u00d78", "mixed."]
    text = " ".join(words)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == reference()(text)
    assert sorted(seen) == sorted([" don't", " a-b", " x1", " 7\u00d78", "."])
    every = [chr(c) for c in range(0xc0, 0x250)] + ["a" + chr(c) + "b" for c in range(0xc0, 0x250)]
    assert [np.frombuffer(enc.encode("z " + w), "<u4").tolist() for w in every] == list(map(reference(), ["z " + w for w in every]))


def test_crc32c_known_values():
    assert B.crc32c_many([b"123456789", b"", b"\x00" * 32, b"\xff" * 32]) == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]
    rng = random.Random(9)
    parts = [rng.randbytes(n) for n in (1, 1023, 1024, 1025, 5000, 3, 2048)]
    assert B.crc32c_many(parts) == [B.crc32c_many([p])[0] for p in parts]
    slow = []
    for p in parts:
        c = 0xFFFFFFFF
        for x in p:
            c = (c >> 8) ^ int(B._TABLE[(c ^ x) & 255])
        slow.append(c ^ 0xFFFFFFFF)
    assert B.crc32c_many(parts) == slow


def test_payload_round_trip():
    many = [[], [0, 127, 128, 16383, 16384, 50256, 2**31, 2**32 - 1], list(range(3000)), []]
    keys = [None, 0, -5, 2**62]
    got = B.parse(B.serialize(keys, [np.array(x, np.uint32) for x in many]))
    assert [(k, x.tolist()) for k, x in got] == list(zip(keys, many))
    assert B.parse(B.serialize([], [])) == []


def expected(rows, end):
    ref = reference()
    return [(i, np.array(ref(t) + [end], "<u4")) for i, t in rows]


def test_records_round_trip(spark):
    prepare(spark)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (6, "a"), (6, "a")]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, file int, size string")
    got = B.round_trip(df).collect()
    want = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), B.END_ID)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    by_start = sorted(got, key=lambda r: r.start)
    at = 0
    last = -1
    for r in by_start:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at += r.n_tokens
        last = -1 if r.doc_id is None else r.doc_id
    assert B.round_trip(df.limit(0)).collect() == []


def test_shuffled_reads_and_damage(spark):
    prepare(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    folder = new_dir(spark, "records")
    index = B.write_records(df, folder)
    some = index.orderBy("n_tokens").where("doc_id % 2 = 0")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in B.read_records(some, folder).collect()}
    assert got == {i: x.tolist() for i, x in expected(list(enumerate(TEXTS)), B.END_ID) if i % 2 == 0}
    r = index.orderBy("doc_id").first()
    with open(r.file, "r+b") as f:
        f.seek(r.offset + 14)
        f.write(b"\x55")
    with pytest.raises(Exception, match="damaged record"):
        B.read_records(index, folder).collect()


def test_best_fill_equals_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 60)
        got = K.best_fill(counts, room)
        best = max(s for s in (sum(n * x for n, x in zip(ns, counts)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))) if s <= room)
        assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


def test_a_full_group_has_hardly_any_slack():
    rng = random.Random(12)
    lengths = [min(1023, int(rng.expovariate(1 / 400)) + 1) for _ in range(K.GROUP_PIECES)]
    fill = {}
    for (sequence, _), x in zip(K.pack_lengths(lengths), lengths):
        fill[sequence] = fill.get(sequence, 0) + x
    assert max(fill.values()) <= 1024 and sum(lengths) / (1024 * len(fill)) > 0.999


def check_packing(got, docs, window=1024):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    ids = dict(expected(docs, K.END_ID))
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            part = ids[d][r.start:r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids[d])
    used = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        used += at
    return 1 - used / (window * len(by_seq))


def test_packing_edge_rows(spark):
    prepare(spark)
    rows = list(enumerate(TEXTS)) + [(None, "null id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, grp int")
    check_packing(K.pack(K.pieces(df)).collect(), rows)
    check_packing(K.pack(K.pieces(df), group_pieces=5).collect(), rows)
    twice = K.pack(K.pieces(df.union(df))).collect()
    assert len(twice) == 2 * len(K.pieces(df).collect())
    assert K.pack(K.pieces(df.limit(0))).collect() == []
    whole = {r.start: r.ids for r in K.pieces(df, keep_ids=True).where("doc_id = 8").collect()}
    assert b"".join(whole[k] for k in sorted(whole)) == dict(expected(rows, 0))[8].tobytes()


def test_queries_match_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    padding = check_packing(QUERIES["op6_sequence_packing"](spark, sf).collect(), docs)
    assert padding < 0.02          # 200 documents: the last windows run out of lengths
    at, want = 0, []
    for i, x in expected(sorted(docs), B.END_ID):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = QUERIES["op7_binary_records"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
