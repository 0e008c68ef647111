"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Rows with one doc_id count as one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, decontaminate, langid, minhash, suffix_dedup
from terravane.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter (und) and ambiguous ones go; a missing lang is filled in."""
    found = langid.identify(docs, langid.learn(docs), keep=COLUMNS)
    # identify() reads the text beside the kept columns, which hold it too
    return found.where("lang_pred <> 'und' and not ambiguous").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; rows with one id and unlike texts are judged one by one."""
    return minhash.first_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that a document of a smaller id also holds; characters are cut whole."""
    found = suffix_dedup.remove_repeats(docs, whole_characters=True).select("doc_id", F.col("kept").cast("string").alias("text"))
    about = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("about")).withColumnRenamed("doc_id", "_id")
    joined = found.join(about, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text", "about.lang", "about.source", F.length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(F.size("runs") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit integers), and digests of the ids and of the decoded bytes."""
    vocabulary = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest(bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN), keep=("token_ids",))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: Most stages can't be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
