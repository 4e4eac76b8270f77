"""Registered queries of the operators, with their production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decon, fim, lines, neardup, phrases, pii, quality, repeats, secrets, template, warc, wavelet
from tallyframe.llm.common import table
from tallyframe.session import cut_lineage

#: A repeated run of lines goes if it has this many words or more.
LEAST_WORDS = 50
#: Bytes of a string that repeats.
REPEATED_BYTES = 50
#: Collocations of each language.
TOP_PHRASES = 2000


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_documents(manifest, docs.schema["doc_id"].dataType, _partitions(spark))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cut_lineage(quality.score(table(spark, sf_dir, "documents")), "quality")
    return quality.assess(scored, table(spark, sf_dir, "labels"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_runs(docs, LEAST_WORDS, counts=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_warc(warc.write_warc(pages), pages.schema["page_id"].dataType, _partitions(spark)).drop("url")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), REPEATED_BYTES)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {f"{c}_sha256": F.sha2(c, 256) for c in ("output", "restored")}
    return made.withColumns(digests).drop("output", "restored")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), TOP_PHRASES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_wavelet, op3_main_text, op4_secrets, op5_near_duplicates, op6_quality, op7_line_runs, op8_warc, op9_bpe, op10_decontamination, op11_repeated_bytes, op12_fill_in_middle, op13_collocations)
}

ORACLE: dict[str, str] = {"op7_line_runs": lines.oracle(LEAST_WORDS), "op12_fill_in_middle": fim.oracle(), "op13_collocations": phrases.oracle(TOP_PHRASES)}
