"""Entry points over stores and checkpoints: add, scan, compare, decompose, explain, export."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import claims, compare, extract, mixture, score
from .operators.store import ReferenceStore

#: Ids that a store takes, and parents of a blend at most.
MODEL_ID, MOST_PARENTS = re.compile(r"[A-Za-z0-9][\w.\-]*(/[\w.\-]+)?"), 4
#: Vector samples for each parent that the cross-check of a blend needs (fixed value).
CHECKED = 16


class LineageSession:
    """Fingerprints checkpoints, keeps a reference store, and asks where models come from."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.path = spark, store.rstrip("/")
        self.models, self.roles = ReferenceStore(spark, f"{self.path}/models"), ReferenceStore(spark, f"{self.path}/roles")

    def add(self, path: str, model_id: str, overwrite: bool = False) -> None:
        if not MODEL_ID.fullmatch(model_id):
            raise ValueError(f"{model_id!r} is no model id")
        model, roles = extract.fingerprints(self.spark, path, model_id)
        added = model.withColumn("added_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        self.models.add(added, overwrite)
        self.roles.add(roles.withColumn("n_layers", F.size("sigma")), overwrite=True)

    def build(self, checkpoints: dict[str, str], overwrite: bool = False) -> int:
        """Add checkpoints (id to path) that the store doesn't know, or all; how many were added."""
        now = self.models.models()
        known = set() if now is None else {r[0] for r in now.filter(F.col("model_id").isin(*checkpoints)).select("model_id").collect()} if checkpoints else set()
        todo = [i for i in checkpoints if overwrite or i not in known]
        for model_id in todo:
            self.add(checkpoints[model_id], model_id, overwrite)
        return len(todo)

    def remove(self, model_id: str) -> bool:
        self.roles.remove(model_id)
        return self.models.remove(model_id)

    def evidence(self, model: DataFrame, roles: DataFrame) -> DataFrame:
        known = self.models.models()
        pairs = compare.candidates(model, known)
        gated = compare.gates(pairs, known.unionByName(model, allowMissingColumns=True).dropDuplicates(["model_id"]))
        signals = compare.role_signals(gated, compare.prepared(roles), compare.prepared(self.roles.models().drop("n_layers")))
        return compare.evidence(gated, signals)

    def neutral(self) -> dict:
        """Neutral values of the features: means over the store's pairs of different families, where there are enough."""
        known, roles = self.models.models(), self.roles.models()
        pairs = compare.all_pairs(known).filter("family_a <> family_b").select(F.col("a").alias("suspect"), F.col("b").alias("candidate"))
        gated = compare.gates(pairs, known)
        return score.neutral_means(compare.evidence(gated, compare.role_signals(gated, compare.prepared(roles.drop("n_layers")))))

    def scan(self, path: str, model_id: str) -> DataFrame:
        """One row: verdict, best candidate, probability, note, what the card claims, whether that holds, and exit code.

        The row is kept in the store's scans, from which `explain` tells it again.
        """
        model, roles = extract.fingerprints(self.spark, path, model_id)
        scored = score.score(self.evidence(model, roles), self.neutral()).persist()
        verdict = score.judge(model, score.rank(scored))
        supported = scored.filter(F.col("p") >= score.POSITIVE).groupBy("suspect").agg(F.array_sort(F.collect_set("candidate")).alias("positive"))
        card = self.spark.createDataFrame([(model_id, extract.side_file(path, "README.md"))], "suspect string, card string")
        both = verdict.join(supported, "suspect", "left").join(claims.claims(card, "suspect"), "suspect")
        best = F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.array().cast("array<string>"))
        out = claims.consistency(both.withColumn("supported", F.coalesce("positive", best)))
        out = out.drop("positive", "has_claim").withColumn("exit_code", score.exit_code(F.col("verdict"), F.col("status")))
        when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        out = self._kept(out.withColumn("scanned_at", when))
        scored.unpersist()
        return out

    def _kept(self, row: DataFrame) -> DataFrame:
        rows = self.spark.createDataFrame(row.collect(), row.schema)  # one row
        rows.write.mode("append").json(f"{self.path}/scans")
        return rows

    def explain(self, model_id: str) -> DataFrame:
        """The latest scan of a model; no row if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scans")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"{model_id} was never scanned")
        kind = "suspect string, verdict string, best string, p double, deep_quant_note boolean, base_models array<string>, license string, from_scratch boolean, supported array<string>, status string, exit_code int, scanned_at string"
        scans = self.spark.read.schema(kind).json(f"{self.path}/scans").filter(F.col("suspect") == model_id)
        return scans.withColumn("n", F.row_number().over(Window.partitionBy("suspect").orderBy(F.desc("scanned_at")))).filter("n = 1").drop("n")

    def compare(self, path: str, model_id: str) -> DataFrame:
        """Every candidate with its features and probability."""
        model, roles = extract.fingerprints(self.spark, path, model_id)
        return score.score(self.evidence(model, roles))

    def fingerprint(self, path: str, model_id: str) -> tuple[DataFrame, DataFrame]:
        return extract.fingerprints(self.spark, path, model_id)

    def _resolved(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Model and roles of an indexed id, else of a checkpoint's path."""
        known, roles = self.models.models(), self.roles.models()
        if known is not None and not known.filter(F.col("model_id") == name).isEmpty():
            return known.filter(F.col("model_id") == name), roles.filter(F.col("model_id") == name).drop("n_layers")
        if not (os.path.exists(name) or "://" in name):
            raise ValueError(f"{name} is neither in the store nor a checkpoint")
        return extract.fingerprints(self.spark, name, name)

    def decompose(self, target: str, parents: list[str], base: str | None = None) -> DataFrame:
        """One row: weights of parents (with a base: one to three and the base) in a target, all of them ids or paths.

        alphas (parents in order, the base last), rss, rank, recon_cos, best (single candidate), gain, by_role, by_layer,
        check (weights from the vectors, null if these are too few), summary and notes.
        """
        every = [*parents, *([base] if base else [])]
        if not 2 <= len(every) <= MOST_PARENTS or len(set(every)) < len(every):
            raise ValueError("two to four different candidates, a base among them")
        if target in every:
            raise ValueError("a model isn't its own parent")
        found = [self._resolved(x) for x in (target, *every)]
        shapes = {(r["n_layers"], r["hidden"], r["seed"], r.asDict().get("shape")) for m, _ in found for r in m.collect()}  # a row each
        if len(shapes) > 1:
            raise ValueError(f"depth, shape or seed differ: {sorted(map(str, shapes))}")
        layers = next(iter(shapes))[0]

        def stacked(column: str) -> DataFrame:
            rows = found[0][1].select("role", F.size(column).alias("n"), F.posexplode(column).alias("pos", "y"))
            for i, (_, roles) in enumerate(found[1:]):
                rows = rows.join(roles.select("role", F.size(column).alias("n"), F.posexplode(column).alias("pos", f"x{i}")), ["role", "n", "pos"])
            return rows.select("role", "n", "pos", "y", F.array(*[f"x{i}" for i in range(len(every))]).alias("x"))

        rows = stacked("pcs")
        whole = mixture.decomposition(rows, [], "y", "x")
        by_role = mixture.decomposition(rows, ["role"], "y", "x").select("role", "alphas")
        per = rows.filter((F.col("n") % layers == 0) & F.lit(layers >= 2)).withColumn("layer", F.floor(F.col("pos") / (F.col("n") / layers)).cast("int"))
        by_layer = mixture.decomposition(per, ["layer"], "y", "x").select("layer", "alphas")
        check = mixture.decomposition(stacked("vector"), [], "y", "x").filter((F.col("n") >= CHECKED * len(every)) & (F.col("rank") == len(every) - 1))
        return mixture.decomposed(whole, by_role, by_layer, check, len(every), base is not None)

    def info(self) -> DataFrame:
        return self.models.info()

    def export_json(self, path: str) -> None:
        """The store as JSON lines: models and roles."""
        self.models.models().write.json(f"{path.rstrip('/')}/models")
        self.roles.models().write.json(f"{path.rstrip('/')}/roles")
