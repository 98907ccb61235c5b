"""URL filter: allow and block rules, and character language models for the rest.

Rules decide the URLs that they fit, the longest rule first.  The URLs that
rules allow and those that rules block train two character models of variable
order: a character's probability after the last ORDER characters falls back,
in the share MASS / (MASS + times the context was seen), on its probability
after one character less, down to a uniform one.  A URL that no rule fits is
judged by the mean over its characters of the log-likelihood difference,
against a cut calibrated on the URLs that rules decide: the point as many
standard deviations below the mean of the allowed as above that of the blocked.

Only DataFrame functions are used.  URLs are first counted by their shape (host
and path with digits made 0), so that a host that holds a third of all pages
costs one row; characters are counted by context before anything is shuffled,
and only two means and deviations come to the driver.

Defined results: a null URL or one without `://` has empty host and path, fits
no rule and is judged as the empty shape; repeated rows are judged alike;
without any allowed or any blocked URL, all that no rule fits are allowed, and
a mean on the cut is allowed; extra columns are left out; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of context at most; pseudo-count of the shorter context; characters that a uniform model knows.
ORDER, MASS, ALPHABET = 4, 2.0, 128.0
#: Rules are a parameter, held in the plan: no more than this.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, host/path) rules that fits, as a struct of verdict and rule; else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def shape(host: Column, path: Column) -> Column:
    return F.translate(F.concat(host, path), "123456789", "000000000")


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """With a row for each character of a text and of its end mark: gram, the character after the ORDER before it.

    Arrays are laid side by side, one projection after the other: a lambda that
    looks into another array would build that array anew for each element.
    """
    letters = F.concat(F.array_repeat(F.lit(START), ORDER), F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), F.array(F.lit(END)))
    out = df.withColumn("letters", letters).withColumn("runs", F.col("letters"))
    for k in range(1, ORDER + 1):
        out = out.withColumn("runs", F.zip_with("runs", F.slice("letters", k + 1, F.size("letters")), lambda a, b: F.concat(a, b)))
    # explode() would have the optimizer push a filter on the arrays' size below, and build them once more for it
    return out.withColumn("gram", F.explode_outer(F.filter("runs", F.isnotnull))).filter("gram is not null").drop("letters", "runs")


def tails(gram: Column) -> Column:
    """The ends of a gram, from the character alone to the whole."""
    return F.array(*[F.substring(gram, ORDER + 1 - k, k + 1) for k in range(ORDER + 1)])


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, ratio): ratio is the mean log-likelihood difference, for all shapes."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("host"), F.col("path")))
    allowed, blocked = (F.coalesce((F.col("fit.verdict") == v).cast("double"), F.lit(0.0)) for v in ("allow", "block"))
    shapes = scratch.write(rows.groupBy("shape").agg(F.sum(allowed).alias("a"), F.sum(blocked).alias("b")), "shapes")

    cut_up = with_grams(shapes, "shape")
    counts = scratch.write(cut_up.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")
    ends = counts.select("gram", "a", "b", F.explode(tails(F.col("gram"))).alias("tail"))
    seen = ends.filter("a > 0 or b > 0").groupBy("tail").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    seen = scratch.write(seen, "seen")
    context = F.expr("substring(tail, 1, length(tail) - 1)")
    total = seen.groupBy(context.alias("context")).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    parts = ends.select("gram", "tail", context.alias("context")).join(seen, "tail", "left").join(total, "context", "left")
    steps = F.array_sort(F.collect_list(F.struct(F.length("tail").alias("k"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ca", "na", "cb", "nb")])))

    def chance(seen_as: str, of: str) -> Column:
        return F.aggregate("steps", F.lit(1 / ALPHABET), lambda p, s: (s[seen_as] + MASS * p) / (s[of] + MASS))

    ratios = parts.groupBy("gram").agg(steps.alias("steps")).select("gram", (F.log(chance("ca", "na")) - F.log(chance("cb", "nb"))).alias("r"))
    scored = cut_up.join(ratios, "gram").groupBy("shape").agg(F.avg("r").alias("ratio"), F.first("a").alias("a"), F.first("b").alias("b"))
    scored = scratch.write(scored, "scored")
    cut = calibrate(scored)
    out = rows.join(scored.select("shape", "ratio"), "shape", "left")
    judged = F.when(F.col("ratio") < cut, "block").otherwise("allow") if cut is not None else F.lit("allow")
    return out.select(
        F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", judged).alias("verdict"), "ratio"
    )


def calibrate(scored: DataFrame) -> float | None:
    """The cut between the ratios of allowed and blocked URLs; None if either is missing."""

    def moments(n: str) -> list[Column]:
        return [F.sum(n), F.sum(F.col(n) * F.col("ratio")), F.sum(F.col(n) * F.col("ratio") * F.col("ratio"))]

    na, sa, qa, nb, sb, qb = scored.agg(*moments("a"), *moments("b")).first()
    if not na or not nb:
        return None
    ma, mb = sa / na, sb / nb
    da, db = max(qa / na - ma * ma, 0) ** 0.5 + 1e-6, max(qb / nb - mb * mb, 0) ** 0.5 + 1e-6
    return (ma * db + mb * da) / (da + db)
