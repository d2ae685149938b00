"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger is
a Parquet table of (blob, pack, spans): which version of which rule pack has scanned which
blob, and what it found. A run scans only (blob, pack) pairs that the ledger lacks, appends
them, and joins the findings back to all paths that hold the blob. A task keeps one copy of
each blob before the shuffle, so a blob that a third of all rows share is one row per task.

Rules look at bytes; spans are in code points, end exclusive. Null text is the empty blob.
Repeated rows, ties and extra columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, stored, text_bytes
from tessera.plans.hints import bounded_broadcast


@dataclass(frozen=True)
class Rule:
    """``literals``: one of them is in every match. ``group`` must have ``least`` bytes or more."""
    kind: str
    rank: int
    pattern: str
    literals: tuple[str, ...]
    group: int = 0
    least: int = 0
    lower: bool = False


@dataclass(frozen=True)
class RulePack:
    """Rules that share a version; raising the version makes every blob unseen for this pack."""
    name: str
    version: str
    rules: tuple[Rule, ...]

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


# The three base kinds, in their listed order.
BASE = RulePack("base", "1", (
    Rule("assign", 0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "api_key", "apikey"), group=2, least=8, lower=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("AKIA",), least=16),
    Rule("hex", 2, r"[0-9a-f]{32,}", (), least=32),
))
# A private key goes to its END line (of the same label, before the next BEGIN); without one, over the
# header and base64 lines that follow (line ends may be escaped, as in JSON).
_EOL = r"(?:[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*)"
PEM = (r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
       r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----"
       rf"|(?:{_EOL}+(?:[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*|=?[A-Za-z0-9+/]+={{0,2}}(?=[\x20\t]*(?:[\r\n\\\"']|\Z))))*)")
VENDOR = RulePack("vendor", "2", (
    Rule("pem", 3, PEM, ("PRIVATE KEY-----",)),
    Rule("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", (".eyJ",)),
    Rule("forge", 5, r"gh[opsur]_[A-Za-z0-9]{36,}", ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("chat", 6, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
))
PACKS = (BASE, VENDOR)
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _compiled(pack: RulePack):
    return [(r, re.compile(r.pattern.encode()), [x.encode() for x in r.literals]) for r in pack.rules]


def scan(text: bytes, compiled, low: bytes | None = None) -> list[dict]:
    """Spans of one blob, by start and rank: leftmost non-overlapping matches of each rule,
    those whose group is too short dropped afterwards."""
    low = text.lower() if low is None else low
    found = []
    for rule, pattern, literals in compiled:
        where = low if rule.lower else text
        if literals and not any(x in where for x in literals):
            continue
        found += [(m.start(), rule.rank, rule.kind, m.end()) for m in pattern.finditer(where)
                  if m.end(rule.group) - m.start(rule.group) >= rule.least]
    if not found:
        return []
    at = {}
    if not text.isascii():
        last = chars = 0
        for b in sorted({x for f in found for x in (f[0], f[3])}):
            chars += len(text[last:b].decode("utf-8", "replace"))
            at[b], last = chars, b
    spans = sorted((at.get(s, s), r, k, at.get(e, e)) for s, r, k, e in found)
    return [dict(zip(("start", "rank", "kind", "end"), s)) for s in spans]


_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))


def address(text_col: str = "text"):
    """Content address (SHA-256) of a text column."""
    return F.unhex(F.sha2(text_bytes(text_col), 256))


def _one_per_task(batches):
    """First copy of each blob that this task meets; the set holds 32 bytes a blob."""
    seen = set()
    for b in batches:
        blobs = b.column("blob").to_pylist()
        take = []
        for i, x in enumerate(blobs):
            if x not in seen:
                seen.add(x)
                take.append(i)
        if take:
            yield b.take(pa.array(take, pa.int64()))


def read_ledger(spark, ledger: str) -> DataFrame:
    schema = f"blob binary, pack string, spans {SPAN}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def update_ledger(versions: DataFrame, ledger: str, packs: tuple[RulePack, ...] = PACKS, text_col: str = "text") -> None:
    """Scan what the ledger lacks and append it (one committed write: a failed run leaves the
    ledger as it was)."""
    spark = versions.sparkSession
    by_id = {p.id: _compiled(p) for p in packs}
    blobs = versions.select(address(text_col).alias("blob"), text_bytes(text_col).alias("text"))
    seen = (read_ledger(spark, ledger).where(F.col("pack").isin(*by_id))
            .groupBy("blob").agg(F.collect_set("pack").alias("packs")))       # at most one entry a pack
    wanted = F.array(*map(F.lit, by_id))
    unseen = (blobs.select("blob").distinct().join(seen, "blob", "left")
              .select("blob", F.array_except(wanted, F.coalesce("packs", F.array().cast("array<string>"))).alias("packs"))
              .where(F.size("packs") > 0))
    todo = blobs.mapInArrow(_one_per_task, blobs.schema).join(unseen.hint("shuffle_hash"), "blob")

    def run(batches):
        for b in _one_per_task(batches):
            rows = []
            for blob, text, todo_packs in zip(*(b.column(c).to_pylist() for c in ("blob", "text", "packs"))):
                low = text.lower()
                rows += [(blob, p, scan(text, by_id[p], low)) for p in todo_packs]
            blob, pack, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.binary()), pa.array(pack, pa.string()), pa.array(spans, _TYPE)],
                                             names=["blob", "pack", "spans"])

    todo.select("blob", "text", "packs").mapInArrow(run, f"blob binary, pack string, spans {SPAN}").write.mode("append").parquet(ledger)


def findings(spark, ledger: str, packs: tuple[RulePack, ...] = PACKS) -> DataFrame:
    """(blob, spans): the blobs in which the given packs found something."""
    return (read_ledger(spark, ledger).where(F.col("pack").isin(*[p.id for p in packs]) & (F.size("spans") > 0))
            .dropDuplicates(["blob", "pack"])
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))


def scan_versions(versions: DataFrame, ledger: str, packs: tuple[RulePack, ...] = PACKS, text_col: str = "text") -> DataFrame:
    """``versions`` without its text, with ``blob`` and ``spans`` (empty if none), after bringing
    the ledger up to date. Columns of these two names are replaced."""
    update_ledger(versions, ledger, packs, text_col)
    found = findings(versions.sparkSession, ledger, packs)
    paths = versions.withColumn("blob", address(text_col)).drop(text_col, "spans")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def redact(docs: DataFrame, ledger: str, packs: tuple[RulePack, ...] = PACKS, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by ``mark``; texts without
    findings, nulls included, stay as they are."""
    blob = free_name(docs.columns, "blob")
    spans = free_name([*docs.columns, blob], "spans")
    found = stored(findings(docs.sparkSession, ledger, packs).select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "secret-findings")
    # While the addresses with findings fit the bound, they are sent to the rows: clean texts are not
    # shuffled, and the few others meet their spans. Beyond it all rows meet them in one join.
    dirty = found.select(blob)
    few = bounded_broadcast(dirty)
    docs_at = docs.withColumn(blob, address(text_col))

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, ss):
            out, last = [], 0
            for s, e in sorted((x["start"], x["end"]) for x in ss):
                if e > last:
                    out += [t[last:s], mark] if s >= last else []
                    last = e
            return "".join(out) + t[last:]
        return text.combine(spans, lambda t, ss: t if ss is None or t is None else one(t, ss))

    if few is dirty:
        joined = docs_at.join(found, blob, "left")
        return joined.withColumn(text_col, cut(F.col(text_col), F.col(spans))).select(docs.columns)
    changed = docs_at.join(few, blob, "left_semi").join(found, blob).withColumn(text_col, cut(F.col(text_col), F.col(spans)))
    return docs_at.join(few, blob, "left_anti").select(docs.columns).union(changed.select(docs.columns))
