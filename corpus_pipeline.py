"""The corpus pipeline over `documents`: quality rules, exact dedup, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, without_ids
from tessera.llm.exact import dropped_rows
from tessera.llm.jaccard import near_copies
from tessera.llm.packing import pack
from tessera.llm.pii import mask_pii
from tessera.llm.quality import filter_quality
from tessera.llm.suffixes import stored


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row in _row. Stored, so that every read sees the same numbers."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rejected documents go."""
    prepare(spark)
    return filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of texts that are equal but for white space, the longest stays. Dropped are rows, not ids: ids may repeat or be null."""
    prepare(spark)
    rows = numbered(docs)
    return without_ids(rows, dropped_rows(rows, "_row"), "_row").drop("_row")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 on five-word shingles, similarity 0.8: one document of each group stays, the one of the smallest id; of rows that tie, one."""
    prepare(spark)
    rows = numbered(docs)
    return without_ids(rows, near_copies(rows, "_row", 5, 80), "_row").drop("_row")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data is masked."""
    prepare(spark)
    return mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces in sequences of 4096 tokens."""
    prepare(spark)
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII", private), ("best-fit packing", packed)]

#: Tokenisers and the packing plan can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
