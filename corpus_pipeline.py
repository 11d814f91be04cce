"""A pipeline over documents: language, boilerplate lines, near-duplicates, secrets, packing.

Each stage works on all that its predecessor kept. The first four return the columns of ``documents``, and further
columns if there are any. Every stage takes an empty table and nulls in any column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuswarden.llm import langid, lines, neardup, packing, secrets
from corpuswarden.llm.shared import kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; nulls and text without letters go.

    The least score lies half-way between chance and what 99 of 100 documents kept aside from the fit reach.
    """
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their host, whose copies of a text are one page.

    All rows stay, also those without a line left; a null host is a host of its own.
    """
    return lines.cleaned(docs, copies=True).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, of repeated rows one; documents without words all stay."""
    return neardup.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; text without secrets stays as it is."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is one end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The stages learn models and encode text, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
