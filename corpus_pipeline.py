"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
documents of the next. All but the last return the columns of documents.

Edge cases: a null text, or one without a word, is rejected by the first stage; a null id or source passes through all
stages (a null source is a site for nothing, and a leaf of its own in the mixture); rows with the same id are one
document where lines are cut and items found; of equal or near texts the smallest id stays; columns beyond those of
documents are not read, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.llm.common import shared_dir, table
from hyetos.llm.decontaminate import decontaminate
from hyetos.llm.line_dedup import line_dedup
from hyetos.llm.minhash import near_duplicates
from hyetos.llm.mixing import domain_of, mix
from hyetos.llm.quality import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents of which no word is left."""
    cut = line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items go."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, mixed to the target weights."""
    return mix(docs.select(*COLUMNS).withColumn("domain", domain_of(F.col("source"))))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the near-duplicate stage can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
