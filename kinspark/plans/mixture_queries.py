"""Queries that take blends apart: every child of the zoo as a mixture of its two parents (and a third base)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import mixture
from . import bridge
from .registry import query

R6 = partial(F.round, scale=6)

#: Sample rows of children: y, the two parents' values, a third base's.
SAMPLES = bridge.ZOO + """,
mix AS (SELECT k.model_id AS target, CASE WHEN ix < 32 THEN 'attn.q' ELSE 'mlp.down' END AS role, (ix % 32) // 4 AS layer, y, x1, x2, x3, nparents FROM (
  SELECT k.model_id, unnest(k.vec) AS y, unnest(b.vec) AS x1, unnest(c.vec) AS x2, unnest(d.vec) AS x3, unnest(range(64)) AS ix, 2 AS nparents
  FROM zoo k JOIN zoo b ON b.model_id = k.parent JOIN zoo c ON c.model_id = k.parent2 JOIN zoo d ON d.model_id = (k.parent + 20) % 40 WHERE k.kind >= 0) k)"""


def _fit2(group: str, name: str = "f2") -> str:
    """DuckDB terms of the fit of two candidates for each group."""
    return f"""{name} AS (SELECT {group}, count(*) AS n, sum((x1 - x2) * (y - x2)) / nullif(sum((x1 - x2) * (x1 - x2)), 0) AS a, sum(y * y) AS yy, sum((y - x1) ** 2) AS s0, sum((y - x2) ** 2) AS s1,
  sum(y * x1) AS y0, sum(y * x2) AS y1, sum(x1 * x1) AS x00, sum(x1 * x2) AS x01, sum(x2 * x2) AS x11, sum((x1 - x2) * (y - x2)) AS r0 FROM mix GROUP BY {group}),
{name}g AS (SELECT *, greatest(0, s1 - a * r0) AS rss, (a * y0 + (1 - a) * y1) / (sqrt(yy) * sqrt(a * a * x00 + 2 * a * (1 - a) * x01 + (1 - a) * (1 - a) * x11)) AS recon_cos,
  CASE WHEN least(s0, s1) > 1e-30 THEN 1 - greatest(0, s1 - a * r0) / least(s0, s1) ELSE 0 END AS gain FROM {name})"""


SPREAD = f"""{_fit2('target')}, {_fit2('target, layer', 'fl')}, {_fit2('target, role', 'fr')},
dev AS (SELECT target, greatest(stddev_pop(a), stddev_pop(1 - a)) AS spread FROM fl GROUP BY target)"""


def _samples(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir)
    bases = zoo.filter("kind = -1")
    kids = zoo.filter("kind >= 0").select(F.col("model_id").alias("target"), F.col("vec").alias("y"), "parent", "parent2", ((F.col("parent") + 20) % bridge.BASES).alias("third"))
    for key, name in (("parent", "x1"), ("parent2", "x2"), ("third", "x3")):
        kids = kids.join(F.broadcast(bases.select(F.col("model_id").alias(key), F.col("vec").alias(name))), key)  # bridge.BASES rows
    cells = kids.select("target", F.posexplode(F.arrays_zip("y", "x1", "x2", "x3")).alias("at", "c"))
    role = F.when(F.col("at") < 32, "attn.q").otherwise("mlp.down")
    return cells.select("target", role.alias("role"), F.floor(F.col("at") % 32 / 4).alias("layer"), "c.*")


def _fit(spark, sf_dir, group, xs=("x1", "x2")):
    return mixture.fit(_samples(spark, sf_dir), group, "y", list(xs))


@query("affine_fit_2", f"WITH {SAMPLES}, {_fit2('target')} SELECT target, round(a, 6) AS a1, round(1 - a, 6) AS a2, round(rss, 6) AS rss FROM f2g")
def affine_fit_2(spark, sf_dir):
    return _fit(spark, sf_dir, ["target"]).select("target", R6("a_0").alias("a1"), R6("a_1").alias("a2"), R6("rss").alias("rss"))


@query(
    "affine_fit_3",
    f"""WITH {SAMPLES}, m AS (SELECT target, sum((x1 - x3) * (x1 - x3)) AS g00, sum((x1 - x3) * (x2 - x3)) AS g01, sum((x2 - x3) * (x2 - x3)) AS g11,
  sum((x1 - x3) * (y - x3)) AS r0, sum((x2 - x3) * (y - x3)) AS r1 FROM mix GROUP BY target),
s AS (SELECT target, (r0 * g11 - r1 * g01) / (g00 * g11 - g01 * g01) AS a, (r1 * g00 - r0 * g01) / (g00 * g11 - g01 * g01) AS b FROM m)
SELECT target, round(a, 6) AS a1, round(b, 6) AS a2, round(1 - a - b, 6) AS a3 FROM s""",
)
def affine_fit_3(spark, sf_dir):
    return _fit(spark, sf_dir, ["target"], ("x1", "x2", "x3")).select("target", R6("a_0").alias("a1"), R6("a_1").alias("a2"), R6("a_2").alias("a3"))


@query("affine_fit_any")
def affine_fit_any(spark, sf_dir):
    rows = _samples(spark, sf_dir).select("target", "y", F.array("x1", "x2", "x3").alias("x"))
    return mixture.fit_any(rows, ["target"], "y", "x")


@query("merge_gain", f"WITH {SAMPLES}, {_fit2('target')} SELECT target, round(gain, 6) AS gain, round(recon_cos, 6) AS recon_cos, n FROM f2g")
def merge_gain(spark, sf_dir):
    return _fit(spark, sf_dir, ["target"]).select("target", R6("gain").alias("gain"), R6("recon_cos").alias("recon_cos"), "n")


@query("best_single", f"WITH {SAMPLES}, {_fit2('target')} SELECT target, CASE WHEN s0 <= s1 THEN 0 ELSE 1 END AS best, round(least(s0, s1), 6) AS rss FROM f2g")
def best_single(spark, sf_dir):
    return _fit(spark, sf_dir, ["target"]).select("target", "best", R6("best_rss").alias("rss"))


@query("merge_per_role", f"WITH {SAMPLES}, {_fit2('target, role')} SELECT target, role, round(a, 6) AS a1, round(1 - a, 6) AS a2 FROM f2g")
def merge_per_role(spark, sf_dir):
    return _fit(spark, sf_dir, ["target", "role"]).select("target", "role", R6("a_0").alias("a1"), R6("a_1").alias("a2"))


@query("merge_per_layer", f"WITH {SAMPLES}, {_fit2('target, layer')} SELECT target, layer, round(a, 6) AS a1 FROM f2g")
def merge_per_layer(spark, sf_dir):
    return _fit(spark, sf_dir, ["target", "layer"]).select("target", "layer", R6("a_0").alias("a1"))


@query("alpha_spread", f"WITH {SAMPLES}, {_fit2('target, role')} SELECT target, round(stddev_pop(a), 6) AS s1, round(stddev_pop(1 - a), 6) AS s2 FROM f2g GROUP BY target HAVING count(*) >= 2")
def alpha_spread(spark, sf_dir):
    per = _fit(spark, sf_dir, ["target", "role"]).groupBy("target").agg(F.count("*").alias("n"), R6(F.stddev_pop("a_0")).alias("s1"), R6(F.stddev_pop("a_1")).alias("s2"))
    return per.filter("n >= 2").select("target", "s1", "s2")


NORMS = f"""{SAMPLES}, mixn AS (SELECT target, role, layer, sqrt(sum(y * y)) AS y, sqrt(sum(x1 * x1)) AS x1, sqrt(sum(x2 * x2)) AS x2 FROM mix GROUP BY ALL),
fn AS (SELECT target, sum((x1 - x2) * (y - x2)) / nullif(sum((x1 - x2) * (x1 - x2)), 0) AS a FROM mixn GROUP BY target HAVING count(*) >= 16)"""


def _norm_fit(spark, sf_dir):
    cells = _samples(spark, sf_dir).groupBy("target", "role", "layer").agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("y", "x1", "x2")])
    return mixture.fit(cells, ["target"], "y", ["x1", "x2"]).filter("n >= 16")  # as many vector samples as the cross-check asks for a candidate


@query("merge_f2", f"WITH {NORMS} SELECT target, round(a, 6) AS a1 FROM fn")
def merge_f2(spark, sf_dir):
    return _norm_fit(spark, sf_dir).select("target", R6("a_0").alias("a1"))


_CLASS = "CASE WHEN recon_cos < 0.9 THEN 'UNEXPLAINED' WHEN (a >= 0.05)::INT + (1 - a >= 0.05)::INT <= 1 THEN 'SINGLE_PARENT' WHEN gain >= 0.3 THEN 'MERGE' ELSE 'AMBIGUOUS' END"


@query("merge_summary", f"WITH {SAMPLES}, {_fit2('target')} SELECT target, {_CLASS} AS summary FROM f2g")
def merge_summary(spark, sf_dir):
    return _fit(spark, sf_dir, ["target"]).select("target", mixture.summary(["a_0", "a_1"]).alias("summary"))


@query(
    "merge_notes",
    f"""WITH {NORMS}, {SPREAD} SELECT f2g.target, array_to_string(list_filter([CASE WHEN {_CLASS} = 'MERGE' AND gain < 0.98 THEN 'residual' END,
  CASE WHEN {_CLASS} = 'MERGE' AND spread > 0.1 THEN 'varies by layer' END,
  CASE WHEN {_CLASS} = 'MERGE' AND abs(fn.a - f2g.a) > 0.15 THEN 'cross-check diverges' END,
  CASE WHEN f2g.a < -0.05 OR 1 - f2g.a < -0.05 THEN 'negative weight' END], lambda x : x IS NOT NULL), '; ') AS notes
FROM f2g JOIN dev USING (target) LEFT JOIN fn USING (target)""".replace("(a >= 0.05)", "(f2g.a >= 0.05)").replace("(1 - a >= 0.05)", "(1 - f2g.a >= 0.05)"),
)
def merge_notes(spark, sf_dir):
    whole = _fit(spark, sf_dir, ["target"])
    layers = _fit(spark, sf_dir, ["target", "layer"]).groupBy("target").agg(F.greatest(F.stddev_pop("a_0"), F.stddev_pop("a_1")).alias("spread"))
    check = _norm_fit(spark, sf_dir).select("target", F.col("a_0").alias("check"))
    out = whole.join(layers, "target").join(check, "target", "left").withColumn("summary", mixture.summary(["a_0", "a_1"]))
    out = out.withColumn("diverges", F.abs(F.col("check") - F.col("a_0")))
    return out.select("target", F.array_join(mixture.notes(["a_0", "a_1"], "spread", "diverges"), "; ").alias("notes"))


@query(
    "collinearity",
    f"""WITH {SAMPLES}, m AS (SELECT target, sum((x1 - x3) ** 2) AS g00, sum((x2 - x3) ** 2) AS g11, sum((x1 - x3) * (x2 - x3)) AS g01 FROM mix GROUP BY target),
l AS (SELECT *, sqrt(g00) >= 1e-6 * sqrt(greatest(g00, g11, 1e-60)) AS l0, sqrt(g11) >= 1e-6 * sqrt(greatest(g00, g11, 1e-60)) AS l1 FROM m)
SELECT target, ((NOT l0)::INT + (NOT l1)::INT) AS identical, coalesce((l0 AND l1 AND abs(g01 / nullif(sqrt(g00) * sqrt(g11), 0)) > 0.95)::INT, 0) AS parallel FROM l""",
)
def collinearity(spark, sf_dir):
    m = mixture.moments(_samples(spark, sf_dir), ["target"], "y", ["x1", "x2", "x3"])
    return m.select("target", mixture.collinear(3).alias("c")).select("target", "c.identical", "c.parallel")


ANCHORS = [0.0, 0.5, 0.3, 0.7, 1.0]
_CURVE = "c AS (SELECT layer, layer * 4.0::DOUBLE / 31 AS ix FROM (SELECT unnest(range(32)) AS layer)), t AS (SELECT layer, [0.0, 0.5, 0.3, 0.7, 1.0]::DOUBLE[] AS v, least(floor(ix), 3)::INT AS i, ix FROM c)"


@query("slerp_curve", f"WITH {_CURVE} SELECT layer::INT AS layer, round(v[i + 1] + (ix - i) * (v[i + 2] - v[i + 1]), 6) AS t FROM t")
def slerp_curve(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(mixture.slerp_curve(ANCHORS, 32))]
    return spark.createDataFrame(rows, "layer int, t double").select("layer", R6("t").alias("t"))


_RECOVERY = """, tl AS (SELECT layer, 0.2 + 0.075 * layer AS t FROM (SELECT unnest(range(8)) AS layer)),
bl AS (SELECT target, mix.layer, t, t * x1 + (1 - t) * x2 AS y, x1, x2 FROM mix JOIN tl ON tl.layer = mix.layer),
fb AS (SELECT target, layer, max(t) AS t, sum((x1 - x2) * (y - x2)) / sum((x1 - x2) * (x1 - x2)) AS a FROM bl GROUP BY target, layer)
SELECT target, round(covar_pop(t, a) / (stddev_pop(t) * stddev_pop(a)), 6) AS r FROM fb GROUP BY target"""


@query("slerp_recovery", f"WITH {SAMPLES}{_RECOVERY}")
def slerp_recovery(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("t", 0.2 + 0.075 * F.col("layer"))
    rows = rows.withColumn("y", F.col("t") * F.col("x1") + (1 - F.col("t")) * F.col("x2"))
    fits = mixture.fit(rows, ["target", "layer", "t"], "y", ["x1", "x2"])
    r = F.try_divide(F.covar_pop("t", "a_0"), F.stddev_pop("t") * F.stddev_pop("a_0"))
    return fits.groupBy("target").agg(R6(F.coalesce(r, F.lit(0.0))).alias("r"))


@query("merge_edges", f"WITH {SAMPLES}, {_fit2('target')}, w AS (SELECT f.target, z.parent, f.a AS alpha FROM f2g f JOIN zoo z ON z.model_id = f.target UNION ALL SELECT f.target, z.parent2, 1 - f.a FROM f2g f JOIN zoo z ON z.model_id = f.target) SELECT target, parent, round(alpha, 3) AS alpha FROM w WHERE alpha >= 0.05")
def merge_edges(spark, sf_dir):
    return _alphas(spark, sf_dir).filter(F.col("alpha") >= mixture.MATERIAL).select("target", "parent", F.round("alpha", 3).alias("alpha"))


def _alphas(spark, sf_dir):
    z = bridge.zoo(spark, sf_dir).filter("kind >= 0").select(F.col("model_id").alias("target"), "parent", "parent2")
    pairs = F.array(F.struct(F.col("parent").alias("parent"), F.col("a_0").alias("alpha")), F.struct(F.col("parent2").alias("parent"), F.col("a_1").alias("alpha")))
    return _fit(spark, sf_dir, ["target"]).join(z, "target").select("target", F.inline(pairs))


@query("mix_yaml", f"WITH {SAMPLES}, {_fit2('target')}, w AS (SELECT f.target, z.parent, f.a AS alpha FROM f2g f JOIN zoo z ON z.model_id = f.target UNION ALL SELECT f.target, z.parent2, 1 - f.a FROM f2g f JOIN zoo z ON z.model_id = f.target) SELECT target, 'merge_method: linear' || chr(10) || 'models:' || chr(10) || string_agg('  - model: ' || parent || chr(10) || '    parameters:' || chr(10) || '      weight: ' || printf('%.4f', alpha), chr(10) ORDER BY parent::VARCHAR) || chr(10) || 'dtype: bfloat16' || chr(10) AS yaml FROM w GROUP BY target")
def mix_yaml(spark, sf_dir):
    return mixture.mix_yaml(_alphas(spark, sf_dir), ["target"], "parent", "alpha")
