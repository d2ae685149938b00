"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, secret
scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of ``documents``.
Nulls, empty texts and repeated rows are carried as each operator defines. Extra columns of any
name keep their values: what a stage adds for itself takes a name that is free. An empty table
passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, packing, quality, secrets, simhash
from tessera.llm.common import free_name, new_dir, prepare, read, stored


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` numbered once and stored, and the number's column: later passes read the numbers,
    however they are split."""
    row = free_name(docs.columns, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or hold too little content."""
    prepare(spark)
    field = quality.fit(docs, read(spark, sf_dir, "labels"))
    verdict = free_name(docs.columns, "quality_rules")
    return quality.judge(docs, field, out_col=verdict).where(F.col(verdict)["kept"]).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: its smallest doc_id (null last), then its first row."""
    prepare(spark)
    rows, row = _numbered(docs)
    found = simhash.near_duplicates(rows.select("doc_id", "text", F.col(row).alias("row")), extra=("row",))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = found.groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an exact window of a benchmark item."""
    prepare(spark)
    rows, row = _numbered(docs)
    hit = decontam.find(rows, read(spark, sf_dir, "benchmark"), row_col=row).where(F.size("items") > 0).select(F.col("row").alias(row))
    return rows.join(hit.hint("shuffle_hash"), row, "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact every secret; ``n_chars`` follows the text. No document is dropped."""
    prepare(spark)
    ledger = new_dir(spark, "pipeline-ledger")
    secrets.update_ledger(docs.select("text"), ledger)
    out = secrets.redact(docs, ledger)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024."""
    prepare(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("packing", sequence_packing),
]

#: The stages hold a trained field, hashes and a tokenizer that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = new_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
