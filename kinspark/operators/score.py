"""From evidence to a verdict: calibrated probability, gates, ranking and the ordered rules."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from .compare import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the repository

#: Weights, intercept and neutral values of the default model; thresholds of the verdict (fixed values).
WEIGHTS = {"sigma_r": 5.5, "vector_cos": 1.5, "pcs_cos": 4.5, "spectra_r": 1.0}
INTERCEPT = -6.0
NEUTRAL = {"sigma_r": 0.3, "vector_cos": 0.85, "pcs_cos": 0.0, "spectra_r": 0.95}
POSITIVE, ABSTAIN, TIE = 0.90, 0.50, 0.03
EXACT_PCS, EXACT_SIGMA, QUANT_PCS, TUNED_PCS = 0.99995, 0.9999, 0.999, 0.98
POSITIVE_CLASSES = ["EXACT_COPY", "QUANTIZED_COPY", "FINE_TUNE", "SAME_LINEAGE", "LIKELY_MERGE"]


def probability(neutral: dict | None = None, weights: dict | None = None, intercept: float = INTERCEPT) -> Column:
    """Logistic score of the feature columns; a null feature counts as its neutral value (numbers or columns)."""
    neutral, weights, z = neutral or NEUTRAL, weights or WEIGHTS, F.lit(intercept)
    for f in FEATURES:
        fill = neutral[f] if isinstance(neutral[f], Column) else F.lit(neutral[f])
        z = z + F.lit(weights[f]) * F.coalesce(F.col(f), fill)
    return expr.sigmoid(z)


def neutral_means(background: DataFrame, least: int = 5) -> dict:
    """The default neutral values, with the mean over a background's pairs where `least` of them or more have the feature."""
    row = background.agg(*[F.struct(F.count(f).alias("n"), F.avg(f).alias("mean")).alias(f) for f in FEATURES]).first()
    return NEUTRAL | {f: row[f]["mean"] for f in FEATURES if row[f]["n"] >= least}


def ruled_out() -> Column:
    """Why a candidate can't be scored, in the order of the gates; null if it can."""
    none = F.coalesce(*[F.col(f) for f in FEATURES]).isNull()
    return (
        F.when(~F.col("layers_match"), "layer count mismatch")
        .when(~F.col("shape_compatible"), "incompatible tensor shapes")
        .when(none, "no comparable signals")
    )


def score(evidence: DataFrame, neutral: dict | None = None) -> DataFrame:
    out = evidence.withColumn("ruled_out", ruled_out())
    return out.withColumn("p", F.when(F.col("ruled_out").isNull(), probability(neutral)))


def rank(scored: DataFrame) -> DataFrame:
    """Candidates of a suspect: comparable ones first, likeliest first, the smaller id on a tie."""
    order = Window.partitionBy("suspect").orderBy(F.col("p").desc_nulls_last(), "candidate")
    return scored.withColumn("place", F.row_number().over(order))


def positive_class() -> Column:
    """The class of a positive candidate."""
    pcs, sigma = F.col("pcs_cos"), F.coalesce("sigma_r", F.lit(0.0))
    exact = (pcs >= EXACT_PCS) & (sigma >= EXACT_SIGMA)
    packed = (F.col("suspect_dtype") != "") & (F.col("candidate_dtype") != "") & (F.col("suspect_dtype") != F.col("candidate_dtype"))
    return (
        F.when(exact & F.col("inventory_match"), "EXACT_COPY")
        .when(exact, "QUANTIZED_COPY")
        .when((pcs >= QUANT_PCS) & packed, "QUANTIZED_COPY")
        .when(pcs >= TUNED_PCS, "FINE_TUNE")
        .otherwise("SAME_LINEAGE")
    )


def judge(suspects: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row for each suspect (model_id): verdict, best candidate, its probability, and a note on deep quantisation.

    One aggregate over the ranked candidates has all that the rules ask for.
    """
    top = F.struct(F.col("candidate"), F.col("p"), positive_class().alias("kind"), F.col("suspect_dtype").alias("dtype"))
    positive = F.col("p") >= POSITIVE
    facts = ranked.groupBy("suspect").agg(
        F.count("*").alias("n"),
        F.count("p").alias("comparable"),
        F.count(F.when(positive, 1)).alias("positives"),
        F.count_distinct(F.when(positive, F.col("family"))).alias("families"),
        F.max(F.when(F.col("place") == 1, top)).alias("best"),
        F.max(F.when(F.col("place") == 2, F.col("p"))).alias("second"),
    )
    facts = suspects.select(F.col("model_id").alias("suspect")).join(facts, "suspect", "left")
    p = F.col("best.p")
    verdict = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "INSUFFICIENT")
        .when(F.col("comparable") == 0, "NO_MATCH")
        .when((F.col("positives") == 0) & (p >= ABSTAIN), "SAME_FAMILY_UNRESOLVED")
        .when(F.col("positives") == 0, "NO_MATCH")
        .when((F.col("positives") >= 2) & (F.col("families") >= 2), "LIKELY_MERGE")
        .when((F.col("positives") >= 2) & (p - F.col("second") <= TIE), "SAME_FAMILY_UNRESOLVED")
        .otherwise(F.col("best.kind"))
    )
    some = F.col("comparable") > 0
    out = facts.select(
        "suspect", verdict.alias("verdict"), F.when(some, F.col("best.candidate")).alias("best"), F.when(some, p).alias("p"), F.col("best.dtype").alias("dtype")
    )
    deep = (F.col("verdict") == "FINE_TUNE") & F.col("dtype").rlike(r"^i?q\d")
    return out.select("suspect", "verdict", "best", "p", F.coalesce(deep, F.lit(False)).alias("deep_quant_note"))


def exit_code(verdict: Column, status: Column) -> Column:
    """3 for a contradicted claim, 4 without a match, else 0."""
    return F.when(status == "INCONSISTENT", 3).when(verdict.isin("NO_MATCH", "INSUFFICIENT"), 4).otherwise(0)


def fit(features: DataFrame, label: str, epochs: int = 4000, rate: float = 0.5, l2: float = 1e-3, most: int = 200_000) -> DataFrame:
    """Weights (feature, weight) of a logistic model with weights of 0 or more, by full-batch descent from zero.

    The rows are labelled pairs, four numbers each; distinct ones are counted.
    Up to `most` of them are gathered.  More are dealt out evenly to the tasks of
    one job, as many as can run at once, which tell each other their gradients
    in each epoch.  (Where executors come and go, no such job can run; there a
    single task has all rows.)
    """
    rows = features.select(*[F.coalesce(F.col(f), F.lit(NEUTRAL[f])).cast("double").alias(f) for f in FEATURES], F.lit(1.0).alias("one"), F.col(label).cast("double").alias("y"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n")).persist()
    many, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    spark = features.sparkSession
    if many <= most:
        held = rows.toArrow()
        held = np.stack([held.column(c).to_numpy() for c in held.column_names], 1)
        w = descend(held[np.lexsort(held.T[::-1])], total, epochs, rate, l2)
    else:
        together = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"
        parts = rows.repartition(slots(spark) if together else 1)  # not by key: the rows are distinct
        w = parts.mapInArrow(_descent(total, epochs, rate, l2, together), "w array<double>", barrier=together).collect()[0]["w"]
    rows.unpersist()
    return spark.createDataFrame([*zip([*FEATURES, "intercept"], map(float, w))], "feature string, weight double")


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def descend(rows: np.ndarray, total: float, epochs: int, rate: float, l2: float, added=None) -> np.ndarray:
    """Weights and, last, the intercept; `added` makes the gradient over these rows (features, 1, y, n) that over all."""
    w = np.zeros(len(FEATURES) + 1)
    for _ in range(epochs if total else 0):
        g = slopes(rows, w)
        g = (added(g) if added else g) / total
        g[:-1] += l2 * w[:-1]
        w -= rate * g
        w[:-1] = np.maximum(0.0, w[:-1])
    return w


#: Rows whose gradient is taken at once, 56 bytes each.
BLOCK = 1 << 13


def slopes(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The summed gradient of the logistic loss; each row stands for n."""
    g = np.zeros(len(w))
    for at in range(0, len(rows), BLOCK):
        block = rows[at : at + BLOCK]
        x, y, n = block[:, :-2], block[:, -2], block[:, -1]
        g += (n * (1 / (1 + np.exp(-(x @ w))) - y)) @ x
    return g


def _descent(total: float, epochs: int, rate: float, l2: float, together: bool):
    """The descent over the rows of all tasks, which the first returns; rows lie in a file without a name, which memory maps."""

    def run(batches):
        import tempfile
        from contextlib import ExitStack

        import pyarrow as pa
        from pyspark import TaskContext

        with tempfile.TemporaryFile() as file, ExitStack() as stack:
            many = sum(file.write(np.stack([c.to_numpy() for c in batch.columns], 1).tobytes()) for batch in batches) // (8 * (len(FEATURES) + 3))
            file.flush()
            shape = (many, len(FEATURES) + 3)
            rows = np.memmap(file, float, "r", shape=shape) if many else np.zeros(shape)
            w = descend(rows, total, epochs, rate, l2, _adder(stack) if together else None)
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    return run


def _adder(stack):
    """Adds up an array of each task of a barrier stage, to the same sum in all; the first task adds, the others have a connection to it.

    (allGather waits a second each time, so it only tells where the first task listens.)
    """
    import secrets
    import socket

    from pyspark import BarrierTaskContext

    task = BarrierTaskContext.get()
    first, infos = task.partitionId() == 0, task.getTaskInfos()
    host = infos[0].address.rpartition(":")[0].strip("[]")
    if first:
        server = stack.enter_context(socket.create_server(("", 0), family=socket.AF_INET6 if ":" in host else socket.AF_INET, backlog=len(infos)))
    port, token = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if first else "")[0].split()
    others = []

    def opened(link):
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return stack.enter_context(stack.enter_context(link).makefile("rwb"))

    def send(file, what):
        file.write(what)
        file.flush()

    if first:
        while len(others) < len(infos) - 1:
            file = opened(server.accept()[0])
            if file.read(len(token)) == token.encode():  # else it is none of the tasks
                others.append(file)
    else:
        hub = opened(socket.create_connection((host, int(port))))
        send(hub, token.encode())

    def added(g):
        if not first:
            send(hub, g.tobytes())
            return np.frombuffer(hub.read(g.nbytes)).copy()
        each = [g, *(np.frombuffer(file.read(g.nbytes)) for file in others)]
        out = np.array([math.fsum(c) for c in zip(*each, strict=True)])  # exact, so the order of the tasks is nothing to it
        for file in others:
            send(file, out.tobytes())
        return out

    return added
