"""Blends: parent weights by least squares under a sum of one.

With the last candidate as pivot the fit is free in the others' deltas, so a
group's sums of products hold all of it: one partial aggregate, whatever the
number of samples, then a small solve in expressions (two or three candidates)
or with numpy (any number).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A weight under this didn't contribute; gain and cosine that a blend needs; spreads worth a note (fixed values).
MATERIAL, GAIN, EXPLAINED = 0.05, 0.30, 0.90
RESIDUAL, LAYER_SPREAD, CROSS_CHECK = 0.98, 0.10, 0.15
#: Deltas this much shorter than the longest are the pivot itself; correlation from which two are parallel.
IDENTICAL, PARALLEL = 1e-6, 0.95


def moments(samples: DataFrame, group: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums of products of y, each candidate, and the deltas to the last one: g_i_j, r_i, yy, y_i, x_i_j, s_i (single residuals)."""
    pivot, k = F.col(xs[-1]), len(xs)
    t, d = F.col(y) - pivot, [F.col(x) - pivot for x in xs[:-1]]
    sums = {"n": F.count("*"), "yy": F.sum(F.col(y) * F.col(y)), "tt": F.sum(t * t)}
    for i in range(k):
        sums[f"y_{i}"] = F.sum(F.col(y) * F.col(xs[i]))
        sums[f"s_{i}"] = F.sum((F.col(y) - F.col(xs[i])) * (F.col(y) - F.col(xs[i])))
        for j in range(i, k):
            sums[f"x_{i}_{j}"] = F.sum(F.col(xs[i]) * F.col(xs[j]))
    for i in range(k - 1):
        sums[f"r_{i}"] = F.sum(d[i] * t)
        for j in range(i, k - 1):
            sums[f"g_{i}_{j}"] = F.sum(d[i] * d[j])
    aggregates = [c.alias(n) for n, c in sums.items()]
    return samples.groupBy(*group).agg(*aggregates) if group else samples.agg(*aggregates)


def weights(k: int) -> list[Column]:
    """The weights a_0 .. from moments; null where the deltas are dependent."""
    c = F.col
    if k == 1:
        return [F.lit(1.0)]
    if k == 2:
        a = F.try_divide(c("r_0"), c("g_0_0"))
        return [a, 1 - a]
    if k == 3:
        det = c("g_0_0") * c("g_1_1") - c("g_0_1") * c("g_0_1")
        a = F.try_divide(c("r_0") * c("g_1_1") - c("r_1") * c("g_0_1"), det)
        b = F.try_divide(c("r_1") * c("g_0_0") - c("r_0") * c("g_0_1"), det)
        return [a, b, 1 - a - b]
    raise ValueError("expressions solve up to three candidates; fit_any solves more")


def fit(samples: DataFrame, group: list[str], y: str, xs: list[str]) -> DataFrame:
    """Adds to the moments a_i, rss, recon_cos, best (place of the best single candidate) and gain."""
    k = len(xs)
    out = moments(samples, group, y, xs)
    for i, a in enumerate(weights(k)):
        out = out.withColumn(f"a_{i}", a)
    cross = sum((F.col(f"a_{i}") * F.col(f"y_{i}") for i in range(1, k)), F.col("a_0") * F.col("y_0"))
    terms = [(2 if i != j else 1) * F.col(f"a_{i}") * F.col(f"a_{j}") * F.col(f"x_{i}_{j}") for i in range(k) for j in range(i, k)]
    square = sum(terms[1:], terms[0])
    explained = sum((F.col(f"a_{i}") * F.col(f"r_{i}") for i in range(1, k - 1)), F.col("a_0") * F.col("r_0")) if k > 1 else F.lit(0.0)
    out = out.withColumn("rss", F.greatest(F.lit(0.0), F.col("tt") - explained))
    out = out.withColumn("recon_cos", F.coalesce(F.try_divide(cross, F.sqrt(F.col("yy")) * F.sqrt(F.greatest(F.lit(0.0), square))), F.lit(0.0)))
    best = F.array_min(F.array(*[F.struct(F.col(f"s_{i}").alias("s"), F.lit(i).alias("i")) for i in range(k)]))
    out = out.withColumn("best", best["i"]).withColumn("best_rss", best["s"])
    gain = F.when(F.col("best_rss") > 1e-30, 1 - F.col("rss") / F.col("best_rss")).otherwise(0.0)
    return out.withColumn("gain", gain)


def fit_any(samples: DataFrame, group: list[str], y: str, x: str) -> DataFrame:
    """Weights for any number of candidates, x an array: (group.., alphas, rss, rank) by numpy on each group's Gram matrix.

    The Gram sums are a grouped aggregate; only k x k numbers reach Python.
    """
    k_wide = samples.withColumn("_k", F.size(x)).withColumn("_t", F.transform(x, lambda v: F.col(y) - v))
    cells = k_wide.withColumn("_d", F.expr(f"transform({x}, v -> v - element_at({x}, -1))")).withColumn("_y", F.col(y) - F.element_at(x, -1))
    cells = cells.select(*group, F.posexplode(F.concat("_d", F.array("_y"))).alias("i", "a"), F.concat("_d", F.array("_y")).alias("_all"))
    cells = cells.select(*group, "i", "a", F.posexplode("_all").alias("j", "b"))
    gram = cells.groupBy(*group, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    kinds = ", ".join(f"`{g}` {samples.schema[g].dataType.simpleString()}" for g in group)

    def solve(key, rows):
        import pyarrow as pa

        i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "v"))
        m = np.zeros((i.max() + 1, j.max() + 1))
        m[i, j] = v
        k = len(m) - 1  # candidates; the last delta is the pivot's own, zero
        b, _, rank, _ = np.linalg.lstsq(m[: k - 1, : k - 1], m[: k - 1, k], rcond=1e-12) if k > 1 else (np.zeros(0), None, 1, None)
        rss = max(0.0, float(m[k, k] - b @ m[: k - 1, k])) if k > 1 else float(m[k, k])
        out = {g: pa.array([x.as_py()]) for g, x in zip(group, key)}
        return pa.table(out | {"alphas": pa.array([[*map(float, b), float(1 - b.sum())]]), "rss": pa.array([rss]), "rank": pa.array([int(rank)], pa.int32())})

    return gram.groupBy(*group).applyInArrow(solve, f"{kinds}, alphas array<double>, rss double, rank int")


def decomposition(samples: DataFrame, group: list[str], y: str, x: str) -> DataFrame:
    """(group.., n, alphas, rss, rank, recon_cos, best, gain, identical, parallel) of blends of two candidates or more, x an array.

    Sums of products of the deltas to the last candidate, of the candidates and
    of y are one grouped aggregate; (2k + 1) squared numbers a group reach Python.
    """
    last = F.element_at(x, -1)
    deltas = F.expr(f"transform(slice({x}, 1, size({x}) - 1), v -> v - element_at({x}, -1))")
    every = samples.select(*group, F.size(x).alias("_k"), F.concat(deltas, F.array(F.col(y) - last), F.col(x), F.array(F.col(y))).alias("_all"))
    cells = every.select(*group, "_k", "_all", F.posexplode("_all").alias("i", "a"))
    cells = cells.select(*group, "_k", "i", "a", F.posexplode("_all").alias("j", "b")).filter("i <= j")
    sums = cells.groupBy(*group, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"), F.count("*").alias("n"), F.max("_k").alias("k"))
    keys = group or ["_one"]
    sums = sums if group else sums.withColumn("_one", F.lit(0))
    kinds = "".join(f"`{g}` {sums.schema[g].dataType.simpleString()}, " for g in keys)

    def solve(key, rows):
        import pyarrow as pa

        i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "v"))
        k, n = rows.column("k")[0].as_py(), rows.column("n")[0].as_py()
        m = np.zeros((2 * k + 1, 2 * k + 1))
        m[i, j] = m[j, i] = v
        g, r, tt = m[: k - 1, : k - 1], m[: k - 1, k - 1], m[k - 1, k - 1]
        size = np.sqrt(np.maximum(np.diag(g), 0))
        scale = np.where(size > 0, size, 1)  # of the columns, so that short deltas are solved as well as long ones
        b, _, rank, _ = np.linalg.lstsq(g / np.outer(scale, scale), r / scale, rcond=1e-12)
        b = b / scale
        alphas = np.append(b, 1 - b.sum())
        raw, cross, yy = m[k : 2 * k, k : 2 * k], m[k : 2 * k, 2 * k], m[2 * k, 2 * k]
        rss = max(0.0, float(tt - 2 * b @ r + b @ g @ b))
        # the residual of one candidate alone; the last one's is t itself
        single = np.append([max(0.0, float(tt - 2 * r[c] + g[c, c])) for c in range(k - 1)], tt)
        norm = np.sqrt(max(0.0, float(alphas @ raw @ alphas))) * np.sqrt(yy)
        best = int(single.argmin())
        live = size >= IDENTICAL * max(size.max(), 1e-30)
        pairs = [(c, d) for c in range(k - 1) for d in range(c + 1, k - 1) if live[c] and live[d] and abs(g[c, d]) > PARALLEL * size[c] * size[d]]
        out = {name: pa.array([value.as_py()], value.type) for name, value in zip(keys, key)}
        out |= {
            "n": pa.array([n]), "alphas": pa.array([alphas.tolist()]), "rss": pa.array([rss]), "rank": pa.array([int(rank)], pa.int32()),
            "recon_cos": pa.array([float(alphas @ cross / norm) if norm > 0 else 0.0]), "best": pa.array([best], pa.int32()),
            "gain": pa.array([1 - rss / single[best] if single[best] > 1e-30 else 0.0]), "identical": pa.array([int((~live).sum())], pa.int32()), "parallel": pa.array([len(pairs)], pa.int32()),
        }
        return pa.table(out)

    out = sums.groupBy(*keys).applyInArrow(solve, f"{kinds}n bigint, alphas array<double>, rss double, rank int, recon_cos double, best int, gain double, identical int, parallel int")
    return out if group else out.drop("_one")


def decomposed(whole: DataFrame, by_role: DataFrame, by_layer: DataFrame, check: DataFrame, k: int, base: bool) -> DataFrame:
    """One row: the pooled fit with the fits by role and layer, the cross-check, summary and notes; a base is the last candidate."""
    parents = k - 1 if base else k
    roles = by_role.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "alphas")))).alias("by_role"))
    spread = F.greatest(*[F.stddev_pop(F.col("alphas")[i]) for i in range(k)])
    layers = by_layer.agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "alphas"))), lambda s: s["alphas"]).alias("by_layer"), F.when(F.count("*") >= 2, spread).alias("spread"))
    one = check.agg(F.first("alphas").alias("check"))
    out = whole.crossJoin(F.broadcast(roles)).crossJoin(F.broadcast(layers)).crossJoin(F.broadcast(one))  # a row each
    for i in range(k):
        out = out.withColumn(f"a_{i}", F.col("alphas")[i])
    names = [f"a_{i}" for i in range(parents)]
    out = out.withColumn("summary", summary(names)).withColumn("diverges", F.greatest(*[F.abs(F.col("check")[i] - F.col(f"a_{i}")) for i in range(k)], F.lit(None).cast("double")))
    told = F.concat(
        notes([f"a_{i}" for i in range(k)], "spread", "diverges"),
        F.filter(F.array(F.when(F.col("identical") > 0, "interchangeable candidates"), F.when(F.col("parallel") > 0, "nearly parallel candidates"), F.when(F.col("rank") < k - 1, "rank deficient")), F.isnotnull),
    )
    return out.withColumn("notes", told).select("alphas", "rss", "rank", "recon_cos", "best", "gain", "by_role", "by_layer", "check", "summary", "notes")


def summary(alphas: list[str]) -> Column:
    """The class of a blend from its parents' weights (a base's isn't among them), recon_cos and gain."""
    material = sum((F.when(F.col(a) >= MATERIAL, 1).otherwise(0) for a in alphas[1:]), F.when(F.col(alphas[0]) >= MATERIAL, 1).otherwise(0))
    return (
        F.when(F.col("recon_cos") < EXPLAINED, "UNEXPLAINED")
        .when(material <= 1, "SINGLE_PARENT")
        .when(F.col("gain") >= GAIN, "MERGE")
        .otherwise("AMBIGUOUS")
    )


def collinear(k: int) -> Column:
    """Struct (identical, parallel) from moments: how many deltas are the pivot, and how many pairs of others nearly parallel."""
    longest = F.greatest(*[F.col(f"g_{i}_{i}") for i in range(k - 1)], F.lit(1e-60))
    live = [F.sqrt(f"g_{i}_{i}") >= IDENTICAL * F.sqrt(longest) for i in range(k - 1)]
    same = sum((F.when(x, 0).otherwise(1) for x in live), F.lit(0))
    pairs = F.lit(0)
    for i in range(k - 1):
        for j in range(i + 1, k - 1):
            r = F.abs(F.try_divide(F.col(f"g_{i}_{j}"), F.sqrt(f"g_{i}_{i}") * F.sqrt(f"g_{j}_{j}")))
            pairs = pairs + F.when(live[i] & live[j] & (r > PARALLEL), 1).otherwise(0)
    return F.struct(same.alias("identical"), pairs.alias("parallel"))


def notes(alphas: list[str], spread: str, divergence: str) -> Column:
    """Notes on a blend: what stays unexplained, layers that differ, the cross-check, negative weights."""
    merge = F.col("summary") == "MERGE"
    negative = sum((F.when(F.col(a) < -MATERIAL, 1).otherwise(0) for a in alphas[1:]), F.when(F.col(alphas[0]) < -MATERIAL, 1).otherwise(0))
    made = F.array(
        F.when(merge & (F.col("gain") < RESIDUAL), "residual"),
        F.when(merge & (F.col(spread) > LAYER_SPREAD), "varies by layer"),
        F.when(merge & (F.col(divergence) > CROSS_CHECK), "cross-check diverges"),
        F.when(negative > 0, "negative weight"),
    )
    return F.filter(made, F.isnotnull)


def slerp_curve(anchors: list[float], layers: int) -> list[float]:
    """Anchor values spread evenly over the layers, linear between them."""
    at = np.linspace(0, len(anchors) - 1, layers)
    return [float(x) for x in np.interp(at, np.arange(len(anchors)), anchors)]


def mix_yaml(weights: DataFrame, group: list[str], model: str, weight: str) -> DataFrame:
    """A merge recipe as text for each group: the parents by id, weights with four decimals."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(model).cast("string").alias("m"), F.col(weight).alias("w"))))
    items = F.transform(lines, lambda s: F.format_string("  - model: %s\n    parameters:\n      weight: %.4f", s["m"], s["w"]))
    return weights.groupBy(*group).agg(F.concat(F.lit("merge_method: linear\nmodels:\n"), F.array_join(items, "\n"), F.lit("\ndtype: bfloat16\n")).alias("yaml"))
