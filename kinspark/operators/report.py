"""What people read of results: layers with gaps, cards of blends, logs of scans, rows of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def roles_by_layer(curve: DataFrame) -> DataFrame:
    """(model, role, layer, present): every layer of a model for each of its roles, gaps told."""
    depth = curve.groupBy("model").agg(F.max("layer").alias("last"))
    roles = curve.select("model", "role").distinct().join(depth, "model").select("model", "role", F.explode(F.sequence(F.lit(0).cast("int"), F.col("last").cast("int"))).alias("layer"))
    have = curve.select("model", "role", F.col("layer").cast("int").alias("layer"), F.lit(True).alias("present")).distinct()
    return roles.join(have, ["model", "role", "layer"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def latest(log: DataFrame, target: str, order: list[str]) -> DataFrame:
    """The last row of each target."""
    last = Window.partitionBy(target).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def byte_totals(plan: DataFrame, group: list[str], size: Column, read: Column) -> DataFrame:
    """Bytes of all tensors, and of those that a plan reads."""
    return plan.groupBy(*group).agg(F.sum(size).cast("bigint").alias("total_bytes"), F.sum(read).cast("bigint").alias("bytes_read"))


def merge_cards(weights: DataFrame, target: str, parent: str, alpha: str, published: str | None = None) -> DataFrame:
    """(target, parents, max_error): the parents of each blend, heaviest first, with the published weight where there is one.

    Parents are structs of id, alpha (three decimals), published and base: a parent that a recipe doesn't name.
    """
    said = F.col(published) if published else F.lit(None).cast("double")
    row = F.struct((-F.col(alpha)).alias("order"), F.col(parent).cast("string").alias("id"), F.round(alpha, 3).alias("alpha"), said.alias("published"), said.isNull().alias("base"))
    cards = weights.groupBy(target).agg(F.array_sort(F.collect_list(row)).alias("parents"), F.round(F.max(F.abs(F.col(alpha) - said)), 3).alias("max_error"))
    return cards.withColumn("parents", F.transform("parents", lambda s: F.struct(s["id"], s["alpha"], s["published"], s["base"])))


def polyline(values: Column, width: int = 300, height: int = 80) -> Column:
    """A depth series as an SVG line, scaled to its own range; a flat one runs through the middle."""
    least, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    steps = F.greatest(F.size(values) - 1, F.lit(1))
    at = F.transform(values, lambda v, i: F.format_string("%.1f,%.1f", i * width / steps, F.coalesce(height - F.try_divide((v - least) * height, span), F.lit(height / 2.0))))
    return F.concat(F.lit(f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="currentColor" points="'), F.array_join(at, " "), F.lit('"/></svg>'))


def report_row(model: Column, verdict: Column, best: Column, p: Column) -> Column:
    """A row of an HTML table, probabilities in whole per cent (cut, so that none reads as certain); labels are escaped, missing values a dash."""
    cells = [expr.html_escape(model), expr.html_escape(verdict), expr.html_escape(best), F.concat(F.floor(p * 100).cast("int").cast("string"), F.lit(" %"))]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(c, F.lit("-")), F.lit("</td>")) for c in cells], F.lit("</tr>"))
