"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of ``documents``. A lost executor costs the running stage's tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skein.llm import bpe, decontaminate, jaccard, lines, quality
from skein.llm.common import materialise


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.learning_row())
    return quality.keep_good(docs, quality.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go out of the texts; every document stays. Copies are left to the next stage: lines that only
    they carry to other sites stay."""
    cut = lines.dedup_lines(docs, independent=True)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar word shingles link, the one with the smallest id stays.

    A row goes by its id and its text: rows that are equal in both are one, of which the row with the least hash of all
    columns stays; a text under an id that another text has, too, is judged by itself, the least hash first; rows without
    an id come after all others. Texts without words are linked to nothing.
    """
    id_type = docs.schema["doc_id"].dataType
    absent = F.lit(0 if isinstance(id_type, NumericType) else "").cast(id_type)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", absent).alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = materialise(jaccard.jaccard_components(docs.select(key.alias("key"), "text"), id_col="key", words=5, num=80, den=100), "groups")
    copies = groups.where("key <> component_id").select("key").distinct()
    # the documents' columns travel inside one, where no name can clash
    keyed = docs.select(key.alias("key"), F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("rank"))
    kept = keyed.join(copies, "key", "left_anti")
    repeated = groups.groupBy("key").count().where("count > 1").select("key")
    if repeated.limit(1).count():
        one = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", "rank").alias("row"))
        kept = kept.join(repeated, "key", "left_anti").select("row").unionAll(one.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("byte-level BPE", encode),
]

#: A learnt classifier and edit distances are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
