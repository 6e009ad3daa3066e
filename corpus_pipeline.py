"""A corpus as a training set sees it: five stages over ``documents``, each written and read again.

toxicity: documents that the classifier scores 0.5 or more go. line dedup: runs of lines that stand
earlier in the corpus are cut out, and a document of which nothing is left goes. near-dedup: of each
group of near-duplicates the row with the smallest id stays. decontamination: documents that hold a
benchmark item go. bpe: every remaining text is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from kotonoha.session import written


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that tells rows apart which repeat an id."""
    return docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))


def _same(a: str, b: str):
    return (F.col(f"{a}.__key.text") == F.col(f"{b}.__key.text")) & F.col(f"{a}.__key.id").eqNullSafe(F.col(f"{b}.__key.id"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.passages(rows, model, id_col="row").filter("score < 0.5").select("doc_id.*")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs).filter("n_deleted = 0 or n_deleted < n_lines")
    n_chars = F.when(F.col("n_deleted") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    first = simhash.near_duplicates(keyed, id_col="__key").filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__key")).distinct()
    kept = keyed.alias("a").join(first.alias("b"), _same("a", "b"), "left_semi")
    return kept.withColumn("__id", F.col("__key.id")).withColumn("__text", F.col("__key.text")).dropDuplicates(["__text", "__id"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key").select(F.col("doc_id").alias("__key"))
    return keyed.alias("a").join(found.alias("b"), _same("a", "b"), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.round_trip(docs, ranks, pattern)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near-dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: Segment scans, tilings and merges have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
