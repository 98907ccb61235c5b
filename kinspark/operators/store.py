"""The reference store: models by id in Parquet, partitioned by depth, with add, remove, import and growth."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(store: DataFrame, rows: DataFrame, key: str = "model_id", overwrite: bool = True) -> DataFrame:
    """Rows added; those with a known key replace the old ones, or fail without `overwrite`."""
    if not overwrite and not store.join(rows.select(key), key, "left_semi").isEmpty():
        raise ValueError("already in the store")
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(store: DataFrame, keys: DataFrame, key: str = "model_id") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def import_merge(store: DataFrame, archive: DataFrame, key: str = "model_id", overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged store, counts added and skipped): known keys are skipped unless overwritten."""
    known = archive.join(store.select(key, F.lit(1).alias("_known")).distinct(), key, "left")
    counts = known.agg(
        F.count(F.when(F.lit(overwrite) | F.col("_known").isNull(), 1)).alias("added"), F.count(F.when(~F.lit(overwrite) & F.col("_known").isNotNull(), 1)).alias("skipped")
    )
    if overwrite:
        return upsert(store, archive, key), counts
    return store.unionByName(known.filter("_known is null").drop("_known"), allowMissingColumns=True), counts


def first_source_wins(sources: list[DataFrame], key: str = "model_id") -> DataFrame:
    """The row of each key from the first source that has it; source says which."""
    rows = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r, allowMissingColumns=True)
    return union.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("source"))).filter("_n = 1").drop("_n")


def new_candidates(found: DataFrame, known: list[DataFrame], key: str = "model_id") -> DataFrame:
    """Keys found with their least rank, without those that any store knows."""
    out = found.groupBy(key).agg(F.min("rank").alias("rank"))
    for k in known:
        out = out.join(k.select(key).distinct(), key, "left_anti")
    return out


class ReferenceStore:
    """A store in a folder that all executors share: versions of Parquet tables, the latest named in a small table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return 0
        return self.spark.read.parquet(f"{self.path}/_versions").agg(F.max("version")).first()[0]

    def models(self) -> DataFrame | None:
        v = self.version()
        if not v:
            return None
        kept = self.spark.read.parquet(f"{self.path}/_versions").filter(F.col("version") == v).first()["schema"]  # an emptied store has no files to tell it
        return self.spark.read.schema(StructType.fromJson(json.loads(kept))).parquet(f"{self.path}/v{v}")

    def _publish(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.partitionBy("n_layers").parquet(f"{self.path}/v{v}")
        self.spark.createDataFrame([(v, df.schema.json())], "version int, schema string").write.mode("append").parquet(f"{self.path}/_versions")
        return v

    def add(self, rows: DataFrame, overwrite: bool = False) -> int:
        now = self.models()
        return self._publish(rows if now is None else upsert(now, rows, overwrite=overwrite))

    def remove(self, model_id) -> bool:
        now = self.models()
        if now is None or now.filter(F.col("model_id") == model_id).isEmpty():
            return False
        self._publish(now.filter(F.col("model_id") != model_id))
        return True

    def export(self, path: str) -> None:
        """An archive: Parquet rows, and beside them a manifest (JSON lines) of what it holds."""
        rows = self.models()
        rows.write.parquet(f"{path}/rows")
        held = rows.agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("n_models"), F.lit(self.version()).alias("version"))
        held.withColumn("columns", F.lit(",".join(rows.columns))).write.json(f"{path}/manifest")

    def import_archive(self, path: str, overwrite: bool = False) -> tuple[int, int]:
        archive, now = self.spark.read.parquet(f"{path}/rows"), self.models()
        held = self.spark.read.json(f"{path}/manifest").first()
        if archive.count() != held["n"]:
            raise ValueError(f"{path}: the manifest names {held['n']} rows")
        if now is None:
            n = archive.count()
            self._publish(archive)
            return n, 0
        merged, counts = import_merge(now, archive, overwrite=overwrite)
        added, skipped = counts.first()
        if added:
            self._publish(merged)
        return added, skipped

    def info(self) -> DataFrame:
        return self.models().groupBy("family").agg(F.count("*").alias("n"))
