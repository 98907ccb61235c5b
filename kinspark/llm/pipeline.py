"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all that the one before kept.

Defined results of all stages: rows whose doc_id is null are kept by the
filters, which can't name them; rows with one doc_id are one document, which
goes or stays as a whole, so repeated rows stay as often as they came; null and
empty texts are neither toxic nor near copies nor leaks and stay as they are
until the last stage, where both have no tokens; very long texts are judged
whole; of equal documents the smallest doc_id stays; extra columns, also with
names that an operator uses, go through all stages but the last; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, suffix, toxicity
from .common import Scratch, table

#: Rows up to which the ids to drop are broadcast.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Documents whose doc_id isn't among a few ids."""
    scratch = Scratch(docs.sparkSession, name)
    ids = scratch.write(ids.select("doc_id").distinct(), "drop")
    scratch.release()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine rejects."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return _without(docs, toxicity.score(docs, model).filter(F.col("score") >= toxicity.THRESHOLD), "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id."""
    return _without(docs, jaccard.link(docs).filter("component_id <> doc_id"), "near")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has; bytes left of a cut character are dropped.

    Texts without such a passage, null and empty ones too, stay as they are, as do
    all other columns; n_chars, where there is one, follows the text.
    """
    names = docs.columns
    cut = suffix.cut_repeats(docs, whole=True, carry=tuple(names))
    kept = F.col("kept").cast("string")

    def column(i: int, name: str):
        new = kept if name == "text" else F.char_length(kept).cast(docs.schema[name].dataType) if name == "n_chars" else None
        old = F.col(f"c{i}")
        return (old if new is None else F.when(F.col("n_removed") > 0, new).otherwise(old)).alias(name)

    return cut.select([column(i, name) for i, name in enumerate(names)])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "leaks")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return tokens.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.expr("decode(decoded, 'UTF-8')").alias("text"))
