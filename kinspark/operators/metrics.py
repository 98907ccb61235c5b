"""Quality of scores against labels, each from one grouped pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that distinct scores are cut into for running sums.
PARTS = 64


def distinct_scores(df: DataFrame, score: str, **counts: Column) -> DataFrame:
    """Distinct scores s with counts, and for each count how much lies below it (below_<name>).

    The scores are cut into parts by approximate quantiles; a window runs inside
    each part, and the parts' sums give the offsets, so no task sees all scores.
    """
    out = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(*[c.alias(n) for n, c in counts.items()])
    part = F.lit(0)
    for c in sorted(set(out.approxQuantile("s", [i / PARTS for i in range(1, PARTS)], 0.01))):
        part = part + (F.col("s") > c).cast("int")
    out = out.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy("part").agg(*[F.sum(n).alias(n) for n in counts])
    offsets = {n: F.lit(0) for n in counts}
    for r in sums.collect():  # PARTS rows at most
        for n in counts:
            offsets[n] = offsets[n] + F.when(F.col("part") > r["part"], r[n]).otherwise(0)
    for n in counts:
        out = out.withColumn(f"below_{n}", F.coalesce(F.sum(n).over(inside), F.lit(0)) + offsets[n])
    return out.drop("part")


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with midranks for ties: one row, auroc."""
    y = F.col(label)
    rows = distinct_scores(df.filter(y.isNotNull()), score, p=F.count(F.when(y == 1, 1)), n=F.count(F.when(y == 0, 1)))
    won = F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2))
    return rows.agg(F.try_divide(won, F.sum("p") * F.sum("n")).alias("auroc"))


def midranks(df: DataFrame, score: str) -> DataFrame:
    """The rows with the mean rank of their score, from 1."""
    rows = distinct_scores(df, score, n=F.count("*")).select("s", (F.col("below_n") + (F.col("n") + 1) / 2).alias("midrank"))
    return df.join(rows, F.col(score).cast("double") == F.col("s")).drop("s")


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def quantile(df: DataFrame, score: str, q: float) -> float | None:
    """The exact quantile, linear between neighbours, found among the distinct scores and their running counts; None without scores."""
    rows = distinct_scores(df, score, n=F.count("*"))
    total = rows.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = q * (total - 1)
    low, high = math.floor(at), math.ceil(at)
    a, b = rows.agg(*[F.min(F.when(F.col("below_n") + F.col("n") > k, F.col("s"))) for k in (low, high)]).first()
    return a if low == high else (high - at) * a + (at - low) * b


def tpr_at_fpr(df: DataFrame, score: str, label: str, fpr: float = 0.01) -> DataFrame:
    """Share of positives strictly above the negatives' (1 - fpr) quantile; threshold 1 without negatives.

    The threshold is one number.
    """
    cut = quantile(df.filter(F.col(label) == 0), score, 1 - fpr)
    cut = 1.0 if cut is None else float(cut)
    hits = df.filter(F.col(label) == 1)
    return hits.agg(F.avg((F.col(score) > cut).cast("double")).alias("tpr"), F.max(F.lit(cut)).alias("threshold"))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 5, least: int = 5) -> DataFrame:
    """Mean score, share of positives and their gap in equal bins that hold enough rows; the last bin is closed."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))
    return out.filter(F.col("n") >= least).withColumn("gap", F.abs(F.col("mean_score") - F.col("share")))


def max_gap(df: DataFrame, score: str, label: str) -> DataFrame:
    return calibration_bins(df, score, label).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))


def percentile_range(value: str, low: float = 0.1, high: float = 0.9, least: int = 5) -> Column:
    """'p10–p90' with two decimals, 'n/a' for fewer than `least` values."""
    ends = [F.percentile(value, F.lit(q)) for q in (low, high)]
    return F.when(F.count(value) >= least, F.format_string("%.2f–%.2f", *ends)).otherwise("n/a")
