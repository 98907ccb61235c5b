"""Growth of a store from a stream of fingerprint tables: an extension, the batch form is store.new_candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import ReferenceStore


def grow(spark: SparkSession, source: str, schema: str, store: ReferenceStore, checkpoint: str) -> StreamingQuery:
    """Add the models that arrive as Parquet files in a folder, each once; known ids are skipped, so a replayed batch changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["model_id"])
        known = store.models()
        if known is not None:
            rows = rows.join(known.select("model_id"), "model_id", "left_anti")
        if not rows.isEmpty():
            store.add(rows)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
