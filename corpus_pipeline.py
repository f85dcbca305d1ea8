"""A corpus pipeline: each stage is one operator, written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import read, remove, scratch, shared_dir
from lantern.llm.decontam import decontaminate
from lantern.llm.linededup import dedup_lines
from lantern.llm.packing import pack
from lantern.llm.shingledup import keep_one_alike
from lantern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of similar lines go; n_chars follows the text."""
    return _counted(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with alike 5-word shingles (Jaccard 0.8 or more) stays, the one with the smallest id.

    Candidates are those of operator 6, and for what its two bits do not reach those of MinHash; see shingledup.
    """
    return keep_one_alike(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the remaining documents are packed into."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the learned toxicity lexicon nor best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes when its result is written, and that when the next one's is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = shared_dir(spark)
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(folder)
        docs = spark.read.schema(rows.schema).parquet(folder)
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
