import base64
import hashlib
import io
import random
import zlib

from tessera.llm import warc as W
from tessera.llm.common import new_dir, prepare

PAGES = [(3, "http://a/é b\r\nx", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (9, "u", ""), (4, "u", "é" * 50000),
         (7, "u", "<p>own</p>\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>same</p>"), (None, "u", "nobody else"), (1, "again", "<p>same</p>")]


def expected(pages):
    first = {}
    for i, _, p in pages:
        if i is not None:
            first[p or ""] = min(i, first.get(p or "", i))
    out = []
    for i, _, p in pages:
        raw = (p or "").encode()
        f = first.get(p or "")
        revisit = f is not None and f != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def table(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, key string, first int")


def digest_rows(records):
    got = records.select(W.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "type", W.page_number("refers_to").alias("r"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_round_trip_edge_rows(spark):
    prepare(spark)
    folder = new_dir(spark, "warc")
    manifest = W.write(table(spark, PAGES), folder)
    got = W.read(manifest, folder, keep_payload=True)
    assert digest_rows(got) == expected(PAGES)
    assert got.where("kind = 'gap'").count() == 0
    bodies = {bytes(r.payload) for r in got.where("type = 'response'").collect()}
    assert {(p or "").encode() for _, _, p in PAGES} == bodies
    big = W.write(table(spark, PAGES), new_dir(spark, "warc"), min_revisit_bytes=100)
    assert W.read(big, folder).where("type = 'revisit'").count() == 0
    none = W.write(table(spark, PAGES).limit(0), new_dir(spark, "warc"))
    assert W.read(none, folder).collect() == []


class Handle(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, offset):
        return bytes(self.getbuffer()[offset:offset + n])


def run(data):
    return [(k, s, e, x if k == "gap" else x["record_id"]) for k, s, e, x in W.salvage(Handle(data))]


def test_salvage_recovers_later_records():
    rng = random.Random(11)
    bodies = [rng.randbytes(rng.randrange(1, 3000)) for _ in range(12)]
    plain = [W.record(i, "u", b, None, False) for i, b in enumerate(bodies)]
    for packed in (True, False):
        parts = [zlib.compress(p, 6, wbits=31) if packed else p for p in plain]
        starts = [sum(map(len, parts[:i])) for i in range(13)]
        whole = b"".join(parts)
        assert run(whole) == [("record", starts[i], starts[i + 1], f"<urn:page:{i}>") for i in range(12)]
        hurt = bytearray(whole)
        hurt[starts[3] + len(parts[3]) // 2] ^= 0x40                # damage inside record 3
        hurt[starts[7]:starts[7] + 4] = b"\0\0\0\0"                 # the start of record 7
        got = run(bytes(hurt))
        assert [g[3] for g in got if g[0] == "record"] == [f"<urn:page:{i}>" for i in range(12) if i not in (3, 7)]
        assert [(s, e) for k, s, e, _ in got if k == "gap"] == [(starts[3], starts[4]), (starts[7], starts[8])]
        cut = run(b"junk" + whole[:-10])
        assert cut[0][:3] == ("gap", 0, 4) and cut[-1][:3] == ("gap", starts[11] + 4, len(whole) - 6)
        assert [g[3] for g in cut if g[0] == "record"] == [f"<urn:page:{i}>" for i in range(11)]
    mixed = zlib.compress(plain[0], wbits=31) + plain[1] + b"\x1f\x8b\x08 false start WARC/1.0 no" + zlib.compress(plain[2], wbits=31)
    got = run(mixed)
    assert [g[0] for g in got] == ["record", "record", "gap", "record"]
    assert [s for _, s, _, _ in got][1:] == [e for _, _, e, _ in got][:-1]
    assert run(b"") == [] and run(b"\0" * 10) == [("gap", 0, 10, "no record start")]


def test_starts_across_buffer_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    monkeypatch.setattr(W, "READ", 16)
    rec = W.record(1, "u", b"x" * 500, None, False)
    for pad in range(50, 80):
        got = run(b"\0" * pad + zlib.compress(rec, wbits=31) + b"\0" * pad + rec)
        assert [g[0] for g in got] == ["gap", "record", "gap", "record"]


def test_query_matches_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op5_warc_salvage"](spark, sf).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(pages)
