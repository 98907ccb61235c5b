"""Queries over the zoo: candidates, signals, scores, verdicts, background, graph."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import compare, graph, metrics, score
from . import bridge
from .registry import query

R6 = partial(F.round, scale=6)
PAIRS, ZOO, CELLS = bridge.PAIRS, bridge.ZOO, bridge.CELLS


def _parts(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir)
    return zoo, zoo.filter("kind >= 0"), F.broadcast(zoo.filter("kind = -1"))  # bridge.BASES references


def _gated(spark, sf_dir):
    zoo, kids, bases = _parts(spark, sf_dir)
    meta = zoo.drop("vec")
    pairs = compare.candidates(kids.drop("vec"), bases.drop("vec"))
    keep = ["n_layers", "hidden", "inventory", "dtype", "seed", "family"]
    a = meta.select(F.col("model_id").alias("suspect"), *[F.col(c).alias(f"s_{c}") for c in keep])
    b = F.broadcast(meta.filter("kind = -1").select(F.col("model_id").alias("candidate"), *[F.col(c).alias(f"c_{c}") for c in keep]))
    return compare.gate_columns(pairs.join(a, "suspect").join(b, "candidate"))


def _signals(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir)
    bases = F.broadcast(compare.prepared(bridge.zoo_roles(zoo.filter("kind = -1"))))
    return compare.role_signals(_gated(spark, sf_dir), compare.prepared(bridge.zoo_roles(zoo.filter("kind >= 0"))), bases)


def _scored(spark, sf_dir):
    gated = _gated(spark, sf_dir)
    return score.score(compare.evidence(gated, _signals(spark, sf_dir)))


def _verdicts(spark, sf_dir):
    kids = bridge.zoo(spark, sf_dir).filter("kind >= 0")
    return score.judge(kids, score.rank(_scored(spark, sf_dir)))


@query("candidates", f"WITH {PAIRS} SELECT suspect, candidate FROM pair")
def candidates(spark, sf_dir):
    _, kids, bases = _parts(spark, sf_dir)
    return compare.candidates(kids, bases)


@query("gate_signals", f"WITH {PAIRS} SELECT suspect, candidate, layers_match, shape_compatible, inventory_match, seed_match FROM pair")
def gate_signals(spark, sf_dir):
    return _gated(spark, sf_dir).select("suspect", "candidate", "layers_match", "shape_compatible", "inventory_match", "seed_match")


@query("shape_compatible", f"WITH {PAIRS} SELECT shape_compatible, layers_match, count(*) AS n FROM pair GROUP BY ALL")
def shape_compatible(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("shape_compatible", "layers_match").agg(F.count("*").alias("n"))


@query("shared_roles", f"WITH {CELLS} SELECT a.model_id AS a, b.model_id AS b, a.role FROM (SELECT DISTINCT model_id, role FROM cell) a JOIN (SELECT DISTINCT model_id, role FROM cell) b ON a.role = b.role JOIN zoo z ON z.model_id = b.model_id AND z.kind = -1 JOIN zoo y ON y.model_id = a.model_id AND y.kind >= 0 AND y.parent = b.model_id")
def shared_roles(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir)
    roles = bridge.zoo_roles(zoo).select("model_id", "role")
    a = zoo.filter("kind >= 0").select(F.col("model_id").alias("a"), F.col("parent").alias("b"))
    own = a.join(roles.select(F.col("model_id").alias("a"), "role"), "a")
    return own.join(roles.select(F.col("model_id").alias("b"), "role"), ["b", "role"]).select("a", "b", "role")


@query("role_intersect", f"WITH {CELLS} SELECT y.model_id, list_sort(list_intersect(list(DISTINCT a.role), list(DISTINCT b.role)))::VARCHAR AS roles FROM zoo y JOIN cell a ON a.model_id = y.model_id JOIN cell b ON b.model_id = y.parent WHERE y.kind >= 0 GROUP BY y.model_id")
def role_intersect(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir)
    sets = bridge.zoo_roles(zoo).groupBy("model_id").agg(F.collect_set("role").alias("roles"))
    kids = zoo.filter("kind >= 0").select("model_id", "parent").join(sets, "model_id")
    both = kids.join(sets.select(F.col("model_id").alias("parent"), F.col("roles").alias("theirs")), "parent")
    return both.select("model_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.array_intersect("roles", "theirs")), ", "), F.lit("]")).alias("roles"))


for _name in ("sigma_r", "vector_cos", "vector_norm_r", "pcs_cos", "spectra_r", "spectra_logdist"):
    _key = {"pcs_cos": "pcs_cosine"}.get(_name, _name)

    @query(_key, f"WITH {PAIRS} SELECT suspect, candidate, role, round({_name}, 6) AS {_name} FROM signal")
    def _signal(spark, sf_dir, name=_name):
        return _signals(spark, sf_dir).select("suspect", "candidate", "role", R6(name).alias(name))


@query("spectra_join", f"WITH {PAIRS} SELECT suspect, candidate, a.role, count(DISTINCT a.layer) AS layers FROM pair JOIN sv a ON a.model_id = suspect JOIN sv b ON b.model_id = candidate AND a.role = b.role AND a.layer = b.layer AND a.k = b.k GROUP BY ALL")
def spectra_join(spark, sf_dir):
    _, kids, _ = _parts(spark, sf_dir)
    zoo = bridge.zoo(spark, sf_dir)
    per = bridge.zoo_roles(zoo).select("model_id", "role", F.posexplode("spectra").alias("layer", "s")).filter(F.size("s") >= 4)
    a = candidates(spark, sf_dir).join(per.select(F.col("model_id").alias("suspect"), "role", "layer"), "suspect")
    b = F.broadcast(per.filter(F.col("model_id") < bridge.BASES).select(F.col("model_id").alias("candidate"), "role", "layer"))
    return a.join(b, ["candidate", "role", "layer"]).groupBy("suspect", "candidate", "role").agg(F.count("*").alias("layers"))


FEATS = ", ".join(f"round({f}, 6) AS {f}" for f in compare.FEATURES)


@query("features", f"WITH {PAIRS} SELECT suspect, candidate, {FEATS} FROM feat")
def features(spark, sf_dir):
    ev = compare.evidence(_gated(spark, sf_dir), _signals(spark, sf_dir)).filter("layers_match")
    return ev.select("suspect", "candidate", *[R6(f).alias(f) for f in compare.FEATURES])


@query("calibrate", f"WITH {PAIRS} SELECT suspect, candidate, round(1 / (1 + exp(-(-6 + 5.5 * coalesce(sigma_r, 0.3) + 1.5 * coalesce(vector_cos, 0.85) + 4.5 * coalesce(pcs_cos, 0) + coalesce(spectra_r, 0.95)))), 6) AS p FROM scored")
def calibrate(spark, sf_dir):
    return _scored(spark, sf_dir).select("suspect", "candidate", R6(score.probability()).alias("p"))


@query("score_candidates", f"WITH {PAIRS} SELECT suspect, candidate, ruled_out, round(p, 6) AS p FROM scored")
def score_candidates(spark, sf_dir):
    return _scored(spark, sf_dir).select("suspect", "candidate", "ruled_out", R6("p").alias("p"))


@query("rank_candidates", f"WITH {PAIRS} SELECT suspect, candidate, place FROM ranked")
def rank_candidates(spark, sf_dir):
    return score.rank(_scored(spark, sf_dir)).select("suspect", "candidate", F.col("place").cast("bigint").alias("place"))


@query("topk", f"WITH {PAIRS} SELECT suspect, candidate, place, round(p, 6) AS p FROM ranked WHERE place <= 3")
def topk(spark, sf_dir):
    return score.rank(_scored(spark, sf_dir)).filter("place <= 3").select("suspect", "candidate", F.col("place").cast("bigint").alias("place"), R6("p").alias("p"))


@query("top2_gap", f"WITH {PAIRS} SELECT suspect, round(bp - second, 6) AS gap FROM facts WHERE positives >= 2")
def top2_gap(spark, sf_dir):
    top = score.rank(_scored(spark, sf_dir).filter(F.col("p") >= score.POSITIVE)).filter("place <= 2")
    return top.groupBy("suspect").agg(F.count("*").alias("n"), R6(F.max("p") - F.min("p")).alias("gap")).filter("n = 2").select("suspect", "gap")


@query("positive_families", f"WITH {PAIRS} SELECT suspect, count(DISTINCT family) AS families, count(*) AS positives FROM scored WHERE p >= 0.9 GROUP BY suspect")
def positive_families(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col("p") >= score.POSITIVE).groupBy("suspect").agg(F.count_distinct("family").alias("families"), F.count("*").alias("positives"))


@query("classify_positive", f"WITH {PAIRS} SELECT suspect, cls FROM facts WHERE bp >= 0.9")
def classify_positive(spark, sf_dir):
    best = score.rank(_scored(spark, sf_dir)).filter((F.col("place") == 1) & (F.col("p") >= score.POSITIVE))
    return best.select("suspect", score.positive_class().alias("cls"))


@query("verdict", f"WITH {PAIRS} SELECT suspect, verdict, best, round(p, 6) AS p FROM verdicts")
def verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("suspect", "verdict", "best", R6("p").alias("p"))


@query("quant_note", f"WITH {PAIRS} SELECT suspect, verdict = 'FINE_TUNE' AND regexp_matches(dtype, '^i?q[0-9]') AS noted FROM verdicts")
def quant_note(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("suspect", F.col("deep_quant_note").alias("noted"))


@query("exit_code", f"WITH {PAIRS} SELECT CASE WHEN verdict IN ('NO_MATCH', 'INSUFFICIENT') THEN 4 ELSE 0 END AS code, count(*) AS n FROM verdicts GROUP BY 1")
def exit_code(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy(score.exit_code(F.col("verdict"), F.lit("NO_CLAIM")).alias("code")).agg(F.count("*").alias("n"))


# pairs of references

REFS = CELLS + """,
bp AS (SELECT a.model_id AS a, b.model_id AS b, a.n_layers, a.family AS family_a, b.family AS family_b FROM zoo a JOIN zoo b ON a.n_layers = b.n_layers AND a.model_id < b.model_id WHERE a.kind = -1 AND b.kind = -1),
bs AS (SELECT bp.a, bp.b, x.role, covar_pop(x.sigma, y.sigma) / (stddev_pop(x.sigma) * stddev_pop(y.sigma)) AS sigma_r, sum(x.nrm * y.nrm) / (sqrt(sum(x.nrm * x.nrm)) * sqrt(sum(y.nrm * y.nrm))) AS vector_cos
  FROM bp JOIN cell x ON x.model_id = bp.a JOIN cell y ON y.model_id = bp.b AND x.role = y.role AND x.layer = y.layer GROUP BY ALL),
background AS (SELECT a, b, unnest(['sigma_r', 'vector_cos']) AS feature, unnest([avg(sigma_r), avg(vector_cos)]) AS value FROM bs JOIN bp USING (a, b) WHERE family_a <> family_b GROUP BY a, b)"""


def _background(spark, sf_dir):
    bases = bridge.zoo(spark, sf_dir).filter("kind = -1")
    pairs = compare.all_pairs(bases.drop("vec")).filter("family_a <> family_b")
    roles = bridge.zoo_roles(bases)
    x = roles.select(F.col("model_id").alias("a"), "role", F.col("sigma").alias("xs"), F.col("norms").alias("xn"))
    y = roles.select(F.col("model_id").alias("b"), "role", F.col("sigma").alias("ys"), F.col("norms").alias("yn"))
    both = pairs.join(x, "a").join(y, ["b", "role"])
    means = both.groupBy("a", "b").agg(F.avg(expr.pearson("xs", "ys")).alias("sigma_r"), F.avg(expr.cosine("xn", "yn")).alias("vector_cos"))
    return means.unpivot(["a", "b"], ["sigma_r", "vector_cos"], "feature", "value").filter("value is not null")


@query("all_pairs", f"WITH {REFS} SELECT a, b, n_layers FROM bp")
def all_pairs(spark, sf_dir):
    return compare.all_pairs(bridge.zoo(spark, sf_dir).filter("kind = -1")).select("a", "b", "n_layers")


@query("background_pairs", f"WITH {REFS} SELECT a, b FROM bp WHERE family_a <> family_b")
def background_pairs(spark, sf_dir):
    return compare.all_pairs(bridge.zoo(spark, sf_dir).filter("kind = -1")).filter("family_a <> family_b").select("a", "b")


@query("background", f"WITH {REFS} SELECT a, b, feature, round(value, 6) AS value FROM background")
def background(spark, sf_dir):
    return _background(spark, sf_dir).select("a", "b", "feature", R6("value").alias("value"))


@query("background_range", f"WITH {REFS} SELECT feature, CASE WHEN count(*) >= 5 THEN printf('%.2f–%.2f', quantile_cont(value, 0.1), quantile_cont(value, 0.9)) ELSE 'n/a' END AS range FROM background GROUP BY feature")
def background_range(spark, sf_dir):
    return _background(spark, sf_dir).groupBy("feature").agg(metrics.percentile_range("value").alias("range"))


@query("neutral_means", f"WITH {REFS} SELECT feature, round(avg(value), 6) AS mean FROM background GROUP BY feature HAVING count(*) >= 5")
def neutral_means(spark, sf_dir):
    return _background(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean")).filter("n >= 5").select("feature", "mean")


@query("neutral_override", f"WITH {REFS}, d AS (SELECT unnest(['sigma_r', 'vector_cos', 'pcs_cos', 'spectra_r']) AS feature, unnest([0.3, 0.85, 0.0, 0.95]::DOUBLE[]) AS neutral) SELECT d.feature, round(coalesce(m.mean, d.neutral), 6) AS neutral FROM d LEFT JOIN (SELECT feature, avg(value) AS mean FROM background GROUP BY feature HAVING count(*) >= 5) m USING (feature)")
def neutral_override(spark, sf_dir):
    means = _background(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).filter("n >= 5")
    defaults = spark.createDataFrame([*score.NEUTRAL.items()], "feature string, neutral double")
    return defaults.join(means, "feature", "left").select("feature", R6(F.coalesce("mean", "neutral")).alias("neutral"))


# ground truth: a child's parent against every other candidate

TRUTH = PAIRS + ", truth AS (SELECT s.*, z.kind, (z.kind <= 6 AND z.parent = s.candidate)::INT AS y FROM scored s JOIN zoo z ON z.model_id = s.suspect WHERE s.p IS NOT NULL AND (z.kind <= 6 OR z.kind = 7))"


def _truth(spark, sf_dir):
    z = bridge.zoo(spark, sf_dir).filter("kind between 0 and 7").select(F.col("model_id").alias("suspect"), "kind", "parent")
    rows = _scored(spark, sf_dir).filter("p is not null").join(z, "suspect")
    return rows.withColumn("y", ((F.col("kind") <= 6) & (F.col("parent") == F.col("candidate"))).cast("int"))


def _labelled(spark, sf_dir):
    docs, labels = (bridge.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return docs.select("doc_id", "n_chars").join(labels.filter("quality is not null").select("doc_id", "quality"), "doc_id").filter("n_chars is not null")


@query("auroc", "WITH r AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM r) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6)::DOUBLE AS auroc FROM k")
def auroc(spark, sf_dir):
    return metrics.auroc(_labelled(spark, sf_dir), "n_chars", "quality").select(R6("auroc").cast("double").alias("auroc"))


@query("midrank", "WITH r AS (SELECT doc_id, n_chars::DOUBLE AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL) SELECT doc_id, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)::DOUBLE AS midrank FROM r")
def midrank(spark, sf_dir):
    return metrics.midranks(_labelled(spark, sf_dir), "n_chars").select("doc_id", "midrank")


@query("tpr_at_fpr", f"WITH {TRUTH}, t AS (SELECT coalesce(quantile_cont(p, 0.99) FILTER (y = 0), 1.0) AS c FROM truth) SELECT round(avg((p > c)::INT) FILTER (y = 1), 6) AS tpr, round(max(c), 6) AS threshold FROM truth, t")
def tpr_at_fpr(spark, sf_dir):
    return metrics.tpr_at_fpr(_truth(spark, sf_dir), "p", "y").select(R6("tpr").alias("tpr"), R6("threshold").alias("threshold"))


@query("calibration_gap", f"WITH {TRUTH} SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, round(abs(avg(p) - avg(y)), 6) AS gap FROM truth GROUP BY 1 HAVING count(*) >= 5")
def calibration_gap(spark, sf_dir):
    return metrics.calibration_bins(_truth(spark, sf_dir), "p", "y").select("bin", "n", R6("gap").alias("gap"))


SUMMARY = f"{TRUTH} SELECT kind, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, round(min(p) FILTER (y = 1), 6) AS weakest, round(max(p) FILTER (y = 0), 6) AS strongest, count(*) FILTER (y = 0 AND p >= 0.9) AS false_positives FROM truth GROUP BY kind"


@query("bench_summary", f"WITH {SUMMARY}")
def bench_summary(spark, sf_dir):
    p = lambda y: F.when(F.col("y") == y, F.col("p"))
    return _truth(spark, sf_dir).groupBy("kind").agg(
        F.count(p(1)).alias("positives"), F.count(p(0)).alias("negatives"), R6(F.min(p(1))).alias("weakest"), R6(F.max(p(0))).alias("strongest"), F.count(F.when(p(0) >= 0.9, 1)).alias("false_positives")
    )


@query("bench_cross", f"WITH {ZOO} SELECT s.model_id AS suspect, c.model_id AS candidate, s.parent = c.model_id AND s.kind <= 6 AS positive FROM zoo s, zoo c WHERE s.kind >= 0 AND c.kind = -1")
def bench_cross(spark, sf_dir):
    zoo = bridge.zoo(spark, sf_dir).drop("vec")
    listed = F.array(*[F.lit(i).cast("bigint") for i in range(bridge.BASES)])  # the stated references against all rows
    pairs = zoo.filter("kind >= 0").select(F.col("model_id").alias("suspect"), "kind", "parent", F.explode(listed).alias("candidate"))
    return pairs.select("suspect", "candidate", ((F.col("parent") == F.col("candidate")) & (F.col("kind") <= 6)).alias("positive"))


@query("top1_accuracy", f"WITH {PAIRS} SELECT z.kind, round(avg((v.best = z.parent)::INT), 6) AS top1 FROM zoo z JOIN facts v ON v.suspect = z.model_id WHERE z.kind BETWEEN 0 AND 6 AND v.bp IS NOT NULL GROUP BY z.kind")
def top1_accuracy(spark, sf_dir):
    z = bridge.zoo(spark, sf_dir).filter("kind between 0 and 6").select(F.col("model_id").alias("suspect"), "kind", "parent")
    best = score.rank(_scored(spark, sf_dir)).filter("place = 1 and p is not null").select("suspect", "candidate")
    return z.join(best, "suspect").groupBy("kind").agg(R6(F.avg((F.col("candidate") == F.col("parent")).cast("int"))).alias("top1"))


@query("ship_gates", f"WITH {TRUTH}, t AS (SELECT coalesce(quantile_cont(p, 0.99) FILTER (y = 0), 1.0) AS c FROM truth), m AS (SELECT avg((p > c)::INT) FILTER (y = 1) AS tpr, count(*) FILTER (y = 0 AND p >= 0.9) AS fp FROM truth, t) SELECT tpr >= 0.95 AS tpr_ok, fp = 0 AS fp_ok FROM m")
def ship_gates(spark, sf_dir):
    rows = _truth(spark, sf_dir)
    fp = rows.agg((F.count(F.when((F.col("y") == 0) & (F.col("p") >= 0.9), 1)) == 0).alias("fp_ok"))
    return metrics.beside(metrics.tpr_at_fpr(rows, "p", "y").select((F.col("tpr") >= 0.95).alias("tpr_ok")), fp)


@query("calibrator_fit")
def calibrator_fit(spark, sf_dir):
    return score.fit(_truth(spark, sf_dir), "y")


# the atlas over the references and the children's parents

GRAPH = PAIRS + ", gt AS (SELECT model_id AS suspect, parent, 'kind-' || kind AS kind FROM zoo WHERE kind BETWEEN 0 AND 6), lp AS (SELECT least(s.suspect, s.candidate) AS a, greatest(s.suspect, s.candidate) AS b, s.p, gt.kind AS truth_kind, gt.suspect AS child FROM scored s LEFT JOIN gt ON gt.suspect = s.suspect AND gt.parent = s.candidate)"


def _truth_pairs(spark, sf_dir):
    return bridge.zoo(spark, sf_dir).filter("kind between 0 and 6").select(F.col("model_id").alias("suspect"), "parent", F.concat(F.lit("kind-"), F.col("kind").cast("string")).alias("kind"))


def _pairs(spark, sf_dir):
    return _scored(spark, sf_dir).select(F.col("suspect").alias("a"), F.col("candidate").alias("b"), "p")


@query("documented_edges", f"WITH {GRAPH} SELECT a, b, truth_kind, child FROM lp")
def documented_edges(spark, sf_dir):
    return graph.documented(_pairs(spark, sf_dir), _truth_pairs(spark, sf_dir)).select("a", "b", "truth_kind", "child")


@query("atlas_edges", f"WITH {GRAPH} SELECT a, b, round(p, 4) AS p, truth_kind IS NOT NULL AS verified, truth_kind, child FROM lp WHERE p >= 0.9 OR truth_kind IS NOT NULL")
def atlas_edges(spark, sf_dir):
    return graph.edges(_pairs(spark, sf_dir), _truth_pairs(spark, sf_dir)).drop("merge")


@query("undetected_documented", f"WITH {GRAPH} SELECT least(suspect, parent) AS a, greatest(suspect, parent) AS b, kind AS truth_kind FROM gt WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.suspect = gt.suspect AND p.candidate = gt.parent)")
def undetected_documented(spark, sf_dir):
    return graph.undetected(_pairs(spark, sf_dir), _truth_pairs(spark, sf_dir)).select("a", "b", "truth_kind")


@query("pair_except", f"WITH {GRAPH} SELECT least(suspect, parent) AS a, greatest(suspect, parent) AS b FROM gt EXCEPT SELECT a, b FROM lp WHERE p IS NOT NULL")
def pair_except(spark, sf_dir):
    t = _truth_pairs(spark, sf_dir).select(F.least("suspect", "parent").alias("a"), F.greatest("suspect", "parent").alias("b"))
    seen = _pairs(spark, sf_dir).filter("p is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return t.distinct().join(seen, ["a", "b"], "left_anti")


@query("pair_matrix", f"WITH {GRAPH} SELECT a, b, round(p, 4) AS p FROM lp UNION ALL SELECT b, a, round(p, 4) FROM lp")
def pair_matrix(spark, sf_dir):
    return graph.matrix(_pairs(spark, sf_dir)).select("a", "b", F.round("p", 4).alias("p"))


@query("export_models", f"WITH {ZOO} SELECT model_id, family, n_layers, kind = -1 AS is_reference FROM zoo")
def export_models(spark, sf_dir):
    return bridge.zoo(spark, sf_dir).select("model_id", "family", "n_layers", (F.col("kind") == -1).alias("is_reference"))


@query("export_pairs", f"WITH {GRAPH} SELECT a, b, round(p, 4) AS p, truth_kind IS NOT NULL AS documented FROM lp UNION ALL SELECT least(suspect, parent), greatest(suspect, parent), NULL, true FROM gt WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.suspect = gt.suspect AND p.candidate = gt.parent)")
def export_pairs(spark, sf_dir):
    seen = graph.documented(_pairs(spark, sf_dir), _truth_pairs(spark, sf_dir))
    missing = undetected_documented(spark, sf_dir).select("a", "b", F.lit(None).cast("double").alias("p"), F.lit(True).alias("documented"))
    return seen.select("a", "b", F.round("p", 4).alias("p"), F.col("truth_kind").isNotNull().alias("documented")).unionByName(missing)


@query("export_edges", f"WITH {GRAPH} SELECT child, CASE WHEN child = a THEN b ELSE a END AS parent, truth_kind, round(p, 4) AS p FROM lp WHERE truth_kind IS NOT NULL")
def export_edges(spark, sf_dir):
    e = graph.documented(_pairs(spark, sf_dir), _truth_pairs(spark, sf_dir)).filter("truth_kind is not null")
    return e.select("child", F.when(F.col("child") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"), "truth_kind", F.round("p", 4).alias("p"))


@query("bench_export", f"WITH {TRUTH} SELECT suspect, candidate, kind, y, round(p, 4) AS p, CASE WHEN y = 1 AND p >= 0.9 THEN 'hit' WHEN y = 1 THEN 'miss' WHEN p >= 0.9 THEN 'false' ELSE 'clear' END AS outcome FROM truth")
def bench_export(spark, sf_dir):
    sure = F.col("p") >= score.POSITIVE
    outcome = F.when((F.col("y") == 1) & sure, "hit").when(F.col("y") == 1, "miss").when(sure, "false").otherwise("clear")
    return _truth(spark, sf_dir).select("suspect", "candidate", "kind", "y", F.round("p", 4).alias("p"), outcome.alias("outcome"))


@query("atlas_nodes", f"WITH {PAIRS} SELECT z.model_id, z.family, z.n_layers, z.kind = -1 AS is_reference, v.verdict FROM zoo z LEFT JOIN verdicts v ON v.suspect = z.model_id")
def atlas_nodes(spark, sf_dir):
    v = _verdicts(spark, sf_dir).select(F.col("suspect").alias("model_id"), "verdict")
    return bridge.zoo(spark, sf_dir).select("model_id", "family", "n_layers", (F.col("kind") == -1).alias("is_reference")).join(v, "model_id", "left")


@query("db_info", f"WITH {ZOO} SELECT family, count(*) AS n FROM zoo WHERE kind = -1 GROUP BY family")
def db_info(spark, sf_dir):
    return bridge.zoo(spark, sf_dir).filter("kind = -1").groupBy("family").agg(F.count("*").alias("n"))
