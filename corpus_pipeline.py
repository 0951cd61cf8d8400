"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Every stage takes any table of documents with doc_id and text, keeps all its columns (the last returns pieces) and gives no
rows for an empty one. A null text counts as empty. Rows with a null id are judged by quality and decontamination and packed
like any other; line dedup and near-dedup, which tell documents apart by id, let them pass. Repeated rows are one document to
near-dedup and line dedup, and rows of their own to the other stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm.clusters import fresh_path
from ledgerlark.llm.decontaminate import clean
from ledgerlark.llm.line_dedup import drop_duplicate_lines
from ledgerlark.llm.near_dedup import keep_one
from ledgerlark.llm.packing import pack
from ledgerlark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on at most 4096 labelled ones, scores under 0.5 go; without any label all stay.

    Null and empty texts are scored as empty ones; a score of exactly 0.5 stays.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzy copies of a line (similarity 0.8 or more) the first by (doc_id, line number) stays; documents that lose all their lines go.

    Documents that had no line before (null, empty, blank) stay.
    """
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: that of least doc_id.

    Documents without words link with nothing; of rows with one id one stays.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item as a whole, go; with an empty benchmark all stay."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their places in sequences of 2048 tokens; a document without text is its end token."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: The stages' models, signatures and tokens have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
