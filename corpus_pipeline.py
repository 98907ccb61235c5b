"""Corpus cleaning in stages, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinspark.llm import pipeline as stages
from kinspark.llm.common import Scratch, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.drop_near_duplicates),
    ("suffix_array_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("byte_bpe", stages.tokenize),
]

#: Learnt weights, an exact similarity join and token ids: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again before the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
