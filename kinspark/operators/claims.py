"""What a model card claims, and whether a verdict bears it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import POSITIVE, POSITIVE_CLASSES

#: Wordings of a from-scratch claim, in any case (fixed values).
FROM_SCRATCH = r"(?i)train(?:ed)?\s+(?:entirely\s+)?from\s+scratch|pre-?train(?:ed)?\s+from\s+scratch|from-scratch\s+(?:pre-?)?train|not\s+(?:a\s+)?fine-?tun(?:e|ed)\s+of\s+any"
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def unquoted(c: Column) -> Column:
    return F.btrim(F.btrim(c), F.lit("\"'"))


def front_matter(text: Column) -> Column:
    """map<string, array<string>> of a card's front matter: scalars, inline lists and block lists; the last of a key counts.

    A fold over the lines keeps (last key, pairs so far); no user function.
    """
    lines = F.filter(F.split(F.regexp_extract(text, FRONT, 1), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    start = F.struct(F.lit(None).cast("string").alias("key"), F.expr("cast(map() as map<string, struct<scalar: boolean, items: array<string>>>)").alias("out"))

    def step(state: Column, line: Column) -> Column:
        item = F.regexp_extract(line, r"^\s+-\s*(.+)", 1)
        key = F.regexp_extract(line, r"^([A-Za-z0-9_-]+):\s*(.*)", 1)
        value = F.trim(F.regexp_extract(line, r"^([A-Za-z0-9_-]+):\s*(.*)", 2))
        inline = value.startswith("[") & value.endswith("]")
        parts = F.filter(F.transform(F.split(F.substring(value, 2, F.length(value) - 2), ","), unquoted), lambda x: x != "")
        items = F.when(value == "", F.array().cast("array<string>")).when(inline, parts).otherwise(F.array(F.btrim(value, F.lit("\"'"))))
        scalar = (value != "") & ~inline
        old = F.element_at(state["out"], state["key"])

        def put(k: Column, v: Column) -> Column:
            rest = F.map_filter(state["out"], lambda x, _: x != k)
            return F.map_concat(rest, F.map_from_arrays(F.array(k), F.array(v)))

        typed = "struct<scalar: boolean, items: array<string>>"
        is_item = (item != "") & state["key"].isNotNull()
        more = F.when(
            old["scalar"], state["out"]
        ).otherwise(put(state["key"], F.struct(F.lit(False).alias("scalar"), F.concat(old["items"], F.array(unquoted(item))).alias("items")).cast(typed)))
        fresh = F.struct(key.alias("key"), put(key, F.struct(scalar.alias("scalar"), items.alias("items")).cast(typed)).alias("out"))
        kind = "struct<key: string, out: map<string, struct<scalar: boolean, items: array<string>>>>"
        same = F.struct(state["key"].alias("key"), F.when(is_item, more).otherwise(state["out"]).alias("out"))
        return F.when(is_item, same.cast(kind)).when(key != "", fresh.cast(kind)).otherwise(same.cast(kind))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def claims(cards: DataFrame, key: str = "model_id", text: str = "card") -> DataFrame:
    """(key, base_models, license, from_scratch, has_claim) of every card; a null card claims nothing."""
    body = F.regexp_replace(F.col(text), FRONT, "")
    out = cards.select(key, text, front_matter(F.coalesce(F.col(text), F.lit(""))).alias("front"), F.coalesce(body, F.lit("")).alias("body"))
    base, licence = F.element_at("front", F.lit("base_model")), F.element_at("front", F.lit("license"))
    out = out.select(
        key,
        F.coalesce(F.filter(base["items"], lambda x: x != ""), F.array().cast("array<string>")).alias("base_models"),
        F.when(licence["scalar"], licence["items"][0]).otherwise("").alias("license"),
        F.col("body").rlike(FROM_SCRATCH).alias("from_scratch"),
    )
    return out.withColumn("license", F.coalesce("license", F.lit(""))).withColumn("has_claim", (F.size("base_models") > 0) | F.col("from_scratch"))


def matches(claimed: Column, candidate: Column) -> Column:
    """Whether a claimed id names a candidate: whole, or by its last part."""
    a, b = F.lower(claimed), F.lower(candidate)
    tail = F.element_at(F.split(b, "/"), -1)
    return (a == b) | a.endswith(F.concat(F.lit("/"), tail)) | (F.element_at(F.split(a, "/"), -1) == tail)


def consistency(verdicts: DataFrame) -> DataFrame:
    """Adds status to rows with base_models, from_scratch, has_claim, verdict, p and supported (candidate ids)."""
    detected = (F.coalesce("p", F.lit(0.0)) >= POSITIVE) & F.col("verdict").isin(*POSITIVE_CLASSES, "SAME_FAMILY_UNRESOLVED")
    named = F.exists("base_models", lambda c: F.exists("supported", lambda s: matches(c, s)))
    status = (
        F.when(~F.col("has_claim"), "NO_CLAIM")
        .when(F.col("from_scratch") & detected, "INCONSISTENT")
        .when((F.size("base_models") > 0) & detected & named, "CONSISTENT")
        .when((F.size("base_models") > 0) & detected, "INCONSISTENT")
        .otherwise("UNVERIFIED")
    )
    return verdicts.withColumn("status", status)
