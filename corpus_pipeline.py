"""The corpus pipeline: documents that survive quality, line, near-duplicate and contamination filters, as token counts and digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, line_dedup, minhash, quality
from plumbline.llm.common import discard, materialise, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and blank texts are among them.

    A classifier is fitted on the texts themselves. Rows with a null id and repeated rows are judged as others are; an empty table
    stays empty. Columns that are named like results (score, accepted) are the input's and stay.
    """
    others = [c for c in docs.columns if c != "text"]
    done = quality.classify(docs.select("doc_id", "text", F.struct(*others).alias("__row"))).where("accepted")
    return done.select("text", "__row.*").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from the texts; every document stays, and other columns as they are, whatever their names.

    Null sources are a host of their own; null texts stay null; repeated rows count as pages and stay; an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("source", "text")]
    done = line_dedup.drop_boilerplate(docs.select("source", "text", F.struct(*others).alias("__row")))
    return done.select("source", "text", "__row.*").select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (word 5-shingles, similarity 0.8) the document with the smallest id stays.

    Null and blank texts and rows with a null id stay; ids are taken for unique, so rows that repeat a kept id stay as well; an
    empty table stays empty. All columns stay as they are.
    """
    return minhash.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item (or all of a shorter one's) occur go.

    Null texts stay, rows with a null id and repeated rows are scanned as others are, an empty table or benchmark changes
    nothing. All columns stay as they are, whatever their names.
    """
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, encoded and decoded.

    A row for each row, null ids and repeated rows too; null and empty texts have no tokens; an empty table gives none.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: No stage but the second can be expressed in SQL; tests/llm compares the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result but the last is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            discard(before)
    return docs
