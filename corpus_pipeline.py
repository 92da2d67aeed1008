"""Corpus pipeline: documents to token files, in five stages.

Each stage is an operator of ``fraudlens.llm`` at its production parameters. It
takes the documents that its predecessor kept, written as Parquet and read again,
and returns documents; the last returns a row for each document written:

1. quality rules: documents that the rules reject go;
2. SimHash near-dedup: one document of each component stays;
3. benchmark decontamination: contaminated documents go;
4. mixing: documents as the mix takes them, a row for each epoch that takes words;
5. token files: doc_id, start, n_tokens, ids_crc32, read back from the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudlens.llm import decontam, mixing, quality, simhash, token_output
from fraudlens.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: Fingerprints (XXH64), the mix's permutations and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i:
            path = f"{shared_folder(spark, 'pipeline')}/documents"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
