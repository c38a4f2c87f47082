"""Folder watching as a file stream, with an upsert per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def watch(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Whenever files arrive, write the newest row per key to a new version of the table under `target`."""

    def merge(batch: DataFrame, number: int) -> None:
        old = [] if number == 0 else [spark.read.parquet(f"{target}/v{number - 1}")]
        merged = batch
        for o in old:
            merged = merged.unionByName(o)
        latest(merged, key, version).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
