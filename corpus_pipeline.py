"""Corpus pipeline: from raw documents to packed batches, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quill.llm import exact_dedup, mixing, near_dup, packing, quality, token_output
from quill.llm.common import table, written
from quill.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against labelled good text rejects go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more the smallest doc_id stays."""
    return near_dup.drop_near_duplicates(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that weights in token ids meet the tempered marginals of source, language and topic."""
    return mixing.mix(docs, tokens=token_output.n_ids("text", tokenizer())).filter("mix_kept").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids in batches of 65,536 padded ids."""
    return packing.pack(docs, tokens=token_output.n_ids("text", tokenizer()))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # sampling by hashes, fitted models and dynamic programming aren't SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
