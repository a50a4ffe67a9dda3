"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Every stage but the last returns the columns of documents, COLUMNS, whatever else its input has: extra columns go, also those named like an operator's
own. An empty table gives an empty table. Rows are judged one by one: repeated rows and rows with a null doc_id stay or go by their own text, except
that near-dedup keeps the rows of the smallest doc_id of a group and every row without a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm import bpe, decontam, line_dedup, near_dedup, quality_rules
from evidentia.llm.shared import materialize, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies have this similarity of their sets of five-word shingles, in per cent, or more.
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go, and all with fewer than 50 words, so null and empty texts too."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source go; every document stays. A null text stays null, a null source is a host of its own."""
    clean = line_dedup.drop_boilerplate(docs).withColumn("text", F.col("kept_text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Texts without words, or null, are in no group and stay."""
    return near_dedup.keep_first(docs, percent=PERCENT).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. A null or empty text has none and stays."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left; a null text counts as empty."""
    return bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("decontamination", benchmark), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned rules, hashing and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
