"""Pair evidence: candidate joins, the four signal families and their means.

Tables: `model` (model_id, family, n_layers, hidden, inventory, dtype, seed) has
a row for each fingerprint, `roles` (model_id, role, sigma, norms, vector, pcs,
spectra) one for each of its roles, arrays in layer order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

FEATURES = ["sigma_r", "vector_cos", "pcs_cos", "spectra_r"]
#: Rows up to which the reference side of a join is broadcast.
BROADCAST_ROWS = 100_000


def side(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a side whose number of rows the caller knows to be small."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def candidates(suspects: DataFrame, references: DataFrame) -> DataFrame:
    """(suspect, candidate) of equal depth or equal, non-empty inventory; a union of two equi-joins, as OR would be a nested loop."""
    s = suspects.select(F.col("model_id").alias("suspect"), "n_layers", "inventory")
    r = references.select(F.col("model_id").alias("candidate"), "n_layers", "inventory")
    depth = s.join(r.drop("inventory"), "n_layers").select("suspect", "candidate")
    same = s.filter("inventory <> ''").join(r.drop("n_layers"), "inventory").select("suspect", "candidate")
    return depth.union(same).filter("suspect <> candidate").distinct()


GATE_COLUMNS = ["n_layers", "hidden", "inventory", "dtype", "seed", "family"]


def gates(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """Pairs with what decides which signals may be compared."""
    columns = [*GATE_COLUMNS, *(["shape"] if "shape" in model.columns else [])]
    a = model.select(F.col("model_id").alias("suspect"), *[F.col(c).alias(f"s_{c}") for c in columns])
    b = model.select(F.col("model_id").alias("candidate"), *[F.col(c).alias(f"c_{c}") for c in columns])
    return gate_columns(pairs.join(a, "suspect").join(b, "candidate"))


def gate_columns(both: DataFrame) -> DataFrame:
    """The gates of pairs that carry s_.. and c_.. columns of both models; the whole shape counts where models have one, else the width."""
    form = "shape" if "s_shape" in both.columns else "hidden"
    return both.select(
        "suspect",
        "candidate",
        (F.col("s_n_layers") == F.col("c_n_layers")).alias("layers_match"),
        F.col(f"s_{form}").eqNullSafe(F.col(f"c_{form}")).alias("shape_compatible"),
        ((F.col("s_inventory") != "") & (F.col("s_inventory") == F.col("c_inventory"))).alias("inventory_match"),
        (F.col("s_seed") == F.col("c_seed")).alias("seed_match"),
        F.col("s_dtype").alias("suspect_dtype"),
        F.col("c_dtype").alias("candidate_dtype"),
        F.col("c_family").alias("family"),
    )


def prepared(roles: DataFrame) -> DataFrame:
    """Roles with what pairs need, made once for each model: unit arrays, whose products are the similarities.

    Correlations come from centred units, cosines from plain ones; spectra are
    logarithms, centred for each layer.
    """
    out = roles.withColumn("logs", F.transform("spectra", expr.log_floor))
    centred = [F.transform("logs", expr.centred).alias("log_c"), expr.centred("sigma").alias("sigma_c"), expr.centred("norms").alias("norms_c")]
    out = out.select("model_id", "role", "vector", "pcs", "logs", *centred)
    return out.select(
        "model_id", "role", "logs", F.transform("log_c", expr.unit).alias("spectra"), expr.unit("sigma_c").alias("sigma"),
        expr.unit("norms_c").alias("norms"), expr.unit("vector").alias("vector"), expr.unit("pcs").alias("pcs"),
    )


def spectra_signals() -> tuple[Column, Column]:
    """Mean over comparable layers (four values or more) of the correlation of log spectra, and of their distance; null without one."""
    layers = F.arrays_zip(F.col("a_spectra").alias("u"), F.col("b_spectra").alias("v"), F.col("a_logs").alias("x"), F.col("b_logs").alias("y"))
    layers = F.filter(layers, lambda s: F.least(F.size(s["x"]), F.size(s["y"])) >= 4)

    def cut(s: Column, name: str) -> Column:
        return F.slice(s[name], 1, F.least(F.size(s["x"]), F.size(s["y"])))

    def one(s: Column) -> Column:
        return F.when(F.size(s["x"]) == F.size(s["y"]), expr.clip1(expr.dot(s["u"], s["v"]))).otherwise(expr.pearson(cut(s, "x"), cut(s, "y")))

    def apart(s: Column) -> Column:
        squares = F.zip_with(cut(s, "x"), cut(s, "y"), lambda p, q: (p - q) * (p - q))
        return F.sqrt(expr.mean(squares))

    return expr.mean(F.transform(layers, one)), expr.mean(F.transform(layers, apart))


def role_signals(gated: DataFrame, roles: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row for each pair and shared role of prepared roles: the signals that the gates leave, null where one isn't comparable."""
    names = ("sigma", "norms", "vector", "pcs", "spectra", "logs")
    a = roles.select(F.col("model_id").alias("suspect"), "role", *[F.col(c).alias(f"a_{c}") for c in names])
    b = (roles if references is None else references).select(F.col("model_id").alias("candidate"), "role", *[F.col(c).alias(f"b_{c}") for c in names])
    both = gated.filter("layers_match").join(a, "suspect").join(b, ["candidate", "role"])
    equal = {c: F.size(f"a_{c}") == F.size(f"b_{c}") for c in ("sigma", "norms", "vector", "pcs")}
    product = {c: expr.clip1(expr.dot(f"a_{c}", f"b_{c}")) for c in equal}
    r, d = spectra_signals()
    deep = F.col("shape_compatible")
    return both.select(
        "suspect",
        "candidate",
        "role",
        F.when(equal["sigma"] & (F.size("a_sigma") >= 3), product["sigma"]).alias("sigma_r"),
        F.when(equal["vector"], product["vector"]).alias("vector_cos"),
        F.when(equal["vector"] & equal["norms"] & (F.size("a_norms") >= 3), product["norms"]).alias("vector_norm_r"),
        F.when(deep & F.col("seed_match") & equal["pcs"], product["pcs"]).alias("pcs_cos"),
        F.when(deep, r).alias("spectra_r"),
        F.when(deep, d).alias("spectra_logdist"),
    )


def evidence(gated: DataFrame, signals: DataFrame) -> DataFrame:
    """Gated pairs with the mean of each feature over its roles; null, never 0, without any."""
    means = signals.groupBy("suspect", "candidate").agg(*[F.avg(c).alias(c) for c in FEATURES])
    return gated.join(means, ["suspect", "candidate"], "left")


def all_pairs(model: DataFrame) -> DataFrame:
    """Unordered pairs of equal depth, the smaller id first: an equi-join with a residual order."""
    a = model.select("n_layers", F.col("model_id").alias("a"), F.col("family").alias("family_a"))
    b = model.select("n_layers", F.col("model_id").alias("b"), F.col("family").alias("family_b"))
    return a.join(b, "n_layers").filter("a < b").select("a", "b", "n_layers", "family_a", "family_b")


def shared_equal_roles(roles: DataFrame, column: str, group: list[str], models: int) -> DataFrame:
    """Roles that all `models` fingerprints of a group have, with samples of one length."""
    size = F.size(column)
    found = roles.groupBy(*group, "role").agg(F.count_distinct("model_id").alias("k"), F.min(size).alias("low"), F.max(size).alias("high"))
    return found.filter((F.col("k") == models) & (F.col("low") == F.col("high"))).select(*group, "role", F.col("low").alias("n"))
