"""The corpus pipeline: stages that each take the documents their predecessor kept.

Every stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Cases: rows that share a doc_id are judged each by their own text, and only rows equal in doc_id and text share a fate;
null doc_ids, texts and sources pass through; a table without labels, or of one without text, is identified as it is:
the first stage then rejects nothing; empty tables pass as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe, langid, linechunks, shared, shinglejoin, templates

#: Documents whose pooled language probability is lower are rejected, besides those without a letter.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the network recognises; all if there is no label to learn from."""
    return langid.keep_identified(docs, langid.learn(docs), LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines; ``n_chars`` follows the text."""
    done = linechunks.dedup(docs)
    return done.select(*(F.when(F.col("n_lines_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Of a doc_id that names several texts only the texts that are copies go, and of rows equal in both one stays.
    """
    return shinglejoin.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items, re-parameterised ones included."""
    return templates.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept texts, and digests of ids and of the bytes that they decode to."""
    done = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: The first stage is a trained network and the last a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is saved in the shared folder until the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = shared.saved_at(docs, f"stage-{name}")
            if before:
                shared.remove(spark, before)
            before = path
    return docs
