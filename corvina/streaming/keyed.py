"""A table of the newest row of each key, kept by a stream that rewrites only the buckets it changes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class KeyedTable:
    """Rows under `path`, dealt by a hash of `key` into `buckets`; a bucket's files have the number of the batch that wrote
    them.

    state/<batch>.json names the newest version of each bucket after a batch, one number a bucket, and is written
    last, by a rename: a batch counts from then on, and one that is asked for again is skipped. What a broken batch
    has left is overwritten when it is run again; its number is that of no other batch. State, files and
    stream checkpoints lie in whatever store Spark reaches.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str
    version: str
    buckets: int = 64

    def _store(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        folder, store = self._store("state")
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def versions(self) -> dict[int, int]:
        """Bucket -> the batch that wrote it last."""
        done = self._batches()
        if not done:
            return {}
        text = self.spark.read.text(f"{self.path}/state/{done[-1]}.json", wholetext=True).first()["value"]
        return {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, batch: int, versions: dict[int, int]) -> None:
        draft, store = self._store(f"state/.{batch}.draft")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        if not store.rename(draft, self._store(f"state/{batch}.json")[0]):
            raise RuntimeError(f"batch {batch} could not be committed")

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The newest row of each key after the last whole batch."""
        return self._rows(self.versions())

    def merge(self, batch_rows: DataFrame, batch: int) -> None:
        """Take a batch: each key keeps its row of the highest version, of equal ones the later batch's.

        A key's rows of one batch and version are told apart by their content, so a repeated batch gives the same table. Rows
        without a key are left out; a null version is older than any other.
        """
        if batch in self._batches():
            return
        columns = self.spark.createDataFrame([], self.schema).columns
        order = F.struct(F.col(self.version).isNotNull(), F.col(self.version), "_new", F.to_json(F.struct(*columns)))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = batch_rows.select(*columns).where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(F.col(self.version).isNotNull(), F.col(self.version), F.to_json(F.struct(*columns)))).alias("_row")).select("_row.*")
        new = new.withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most one number a bucket
            versions = self.versions()
            old = self._rows({b: versions[b] for b in touched if b in versions})
            both = new.drop("bucket").withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
            kept = both.groupBy(self.key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*").withColumn("bucket", bucket)
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
        finally:
            new.unpersist()
        self._commit(batch, versions | dict.fromkeys(touched, batch))

    def follow(self, folder: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
        """Merge the files that arrive in a folder, at most `files` a batch, until none is left."""
        reader = self.spark.readStream.schema(self.schema)
        stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
