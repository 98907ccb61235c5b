"""The atlas: nodes, edges, documented pairs, and what is exported of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

EDGE = 0.9


def documented(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) with the ground truth of either direction: kind and child, null without."""
    t = truth.select(
        F.least("suspect", "parent").alias("a"), F.greatest("suspect", "parent").alias("b"), F.col("kind").alias("truth_kind"), F.col("suspect").alias("child")
    ).dropDuplicates(["a", "b"])
    low = pairs.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b")).drop("a", "b")
    return low.withColumnsRenamed({"_a": "a", "_b": "b"}).join(t, ["a", "b"], "left")


def undetected(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Documented pairs that were never compared."""
    t = truth.select(F.least("suspect", "parent").alias("a"), F.greatest("suspect", "parent").alias("b"), F.col("kind").alias("truth_kind"), F.col("suspect").alias("child")).distinct()
    return t.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def edges(scored: DataFrame, truth: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Likely, documented or blended pairs: (a, b, p, verified, truth_kind, child, merge)."""
    out = documented(scored, truth)
    if merges is not None:
        m = merges.select(F.least("target", "parent").alias("a"), F.greatest("target", "parent").alias("b"), F.col("alpha").alias("merge"), F.col("target"))
        out = out.join(m, ["a", "b"], "left").withColumn("child", F.coalesce("target", "child")).drop("target")
    else:
        out = out.withColumn("merge", F.lit(None).cast("double"))
    known = F.col("truth_kind").isNotNull() | F.col("merge").isNotNull()
    return out.filter((F.col("p") >= EDGE) | known).select("a", "b", F.round("p", 4).alias("p"), known.alias("verified"), "truth_kind", "child", "merge")


def node_order(models: DataFrame) -> DataFrame:
    """Models by group, family and name with their place; families are few, so their counts place the blocks."""
    out = models.withColumn("group", names.group_of("family"))
    sizes = out.groupBy("group", "family").agg(F.count("*").alias("n"))
    earlier = sizes.alias("x").join(sizes.alias("y"), F.struct("x.group", "x.family") > F.struct("y.group", "y.family"), "left")
    earlier = earlier.groupBy("x.group", "x.family").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("group", "family").orderBy(F.lower(F.col("model_id").cast("string")), "model_id"))
    return out.withColumn("_n", inside).join(F.broadcast(earlier), ["group", "family"]).withColumn("node", (F.col("before") + F.col("_n") - 1).cast("bigint")).drop("_n", "before")


def inherit_family(models: DataFrame, truth: DataFrame) -> DataFrame:
    """Models outside every group take their documented parent's family."""
    t = truth.join(models.select(F.col("model_id").alias("parent"), F.col("family").alias("parent_family")), "parent")
    t = t.groupBy(F.col("suspect").alias("model_id")).agg(F.min("parent_family").alias("parent_family"))
    out = models.join(t, "model_id", "left")
    return out.withColumn("family", F.when(names.group_of("family") == "Other", F.coalesce("parent_family", "family")).otherwise(F.col("family"))).drop("parent_family")


def matrix(scored: DataFrame) -> DataFrame:
    """Both triangles of the pair scores, in long form."""
    return scored.select("a", "b", "p").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
