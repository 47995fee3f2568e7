"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, packing, pii, toxicity
from tessera.llm.common import dropped, held_out, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; it learns from labels outside the held-out part. Rows with null or empty texts
    are judged as texts without a match. Like every stage it keeps all columns, repeated rows and empty tables as they are."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays; rows with null ids or
    without words all stay, and of rows with the same id and text one."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; null texts stay null."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is its end id alone."""
    return packing.digests(packing.pack(docs))


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("decontamination", benchmark), ("pii", personal), ("packing", packed)]

#: No SQL expresses these stages; a test holds each against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read is deleted when its own result is stored."""
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        own: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), own)
        dropped(spark, last)
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)
