"""Training-data pipeline: quality filter, near-dedup, decontamination, secret redaction, SentencePiece ids.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before it kept;
its result is written as Parquet and read again as the next one's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalspark.llm import decontaminate, near_dedup, quality, secrets, sentencepiece_viterbi
from vitalspark.llm.common import table, tokenizer_file, without, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is 0.5 or more.  Null and empty texts are scored like any other; equal rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates; rows of one doc_id stay or go together.  Null and empty texts, and rows without doc_id, are linked with nothing and stay."""
    return without(docs, near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window.  Null and empty texts have no words and stay, as do rows without doc_id; rows of one doc_id stay or go together."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.keep_clean(docs, found)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the spans of secrets cover replaced, and n_chars counted anew where text changed.  Null texts stay null; repeated rows each have their result."""
    return secrets.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids (array<int>), same (whether they decode to the text) of all documents.  A null text counts as empty; repeated rows each have their result."""
    return sentencepiece_viterbi.encode_and_check(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("SentencePiece", sentencepiece_stage),
]

#: A trained classifier, redaction by recursive decoding and tokenisation have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs, name.replace(" ", "_"))
    return docs
