"""Corpus pipeline: documents -> quality -> line runs -> near duplicates -> benchmark leaks -> token ids.

Each stage takes all that its predecessor kept and returns the columns of documents (the last one the
tokens), is written as Parquet and read again. Parameters are the production ones of the operators; stages on
word shingles take five words and a similarity of 0.8.

In every stage: a null text counts as empty, other nulls are kept as they are; repeated rows are judged alike and stay or go
together; an empty table gives an empty table of the same columns; columns beside those of documents are carried
through (but for the last stage, which returns its own).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decon, lines, neardup, quality
from tallyframe.llm.common import table
from tallyframe.session import cut_lineage

LEAST_WORDS = 50
SHINGLE, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs (fitted on the labelled ones among them). Empty texts
    fail the base rule; a null language is a stratum of its own; without labels the base rule alone decides."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out; a document without a word after that goes (empty texts with it). A null
    doc_id comes before all others; rows equal in doc_id and text count as one document."""
    cut = lines.drop_repeated_runs(docs, LEAST_WORDS)
    cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (rows that share a doc_id stay or go together). Rows without a word
    or without a doc_id are linked with nothing and stay."""
    dropped = neardup.near_duplicates(docs, SHINGLE, SIMILARITY).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty ones hold none. An empty benchmark keeps all."""
    return decon.drop_leaks(docs, table(spark, sf_dir, "benchmark"), SHINGLE, SIMILARITY)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and the ids (little-endian 32-bit integers)."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_runs),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", token_ids),
]

#: Certified cutoffs and merge ranks are beyond SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
