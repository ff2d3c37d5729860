"""A table that streams upsert into: each batch is one version, and a batch that comes again changes nothing."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.staging import new_folder, publish, versions


@dataclass(frozen=True)
class UpsertTable:
    """Rows by key under root, in buckets by the key's hash. A version lists a folder for each bucket, so a batch writes the buckets that it touches alone."""

    root: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 16

    def _manifest(self, spark: SparkSession) -> tuple[int, dict[str, str]]:
        """The batch of the newest version, and its folders by bucket; -1 and none before the first."""
        known = versions(spark, self.root)
        if not known:
            return -1, {}
        about = json.loads(spark.read.parquet(f"{self.root}/{known[-1][1]}/manifest").first()[0])
        return about["batch"], about["folders"]

    def _rows(self, spark: SparkSession, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{build}/rows/bucket={bucket}" for bucket, build in folders.items()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version whole; a batch that is being written is not seen."""
        return self._rows(spark, self._manifest(spark)[1])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the batch's rows take the place of those with their keys, in one new version that knows the batch's number.

        A number that the newest version has already, or a smaller one, is a batch delivered again: nothing is done. A run that fails before
        the version is published leaves files that no version names. Of rows with one key in a batch any may stay: send one.
        """
        spark = batch.sparkSession
        done, folders = self._manifest(spark)
        if batch_id <= done:
            return
        build = f"b{new_folder(spark, 'x').rsplit('-', 1)[1]}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = self.read(spark).columns
        incoming = f"{self.root}/{build}/incoming"
        batch.select(*names).dropDuplicates(list(self.keys)).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(incoming)
        new = spark.read.schema(f"{self.schema}, bucket int").parquet(incoming)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # so many numbers at most as there are buckets
        if touched:
            old = self._rows(spark, {b: f for b, f in folders.items() if int(b) in touched}).join(new.select(*self.keys), list(self.keys), "left_anti")
            merged = old.select(*names).withColumn("bucket", bucket).unionByName(new.select(*names, "bucket"))
            merged.write.partitionBy("bucket").parquet(f"{self.root}/{build}/rows")
        about = {"batch": batch_id, "folders": folders | {str(b): build for b in touched}}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{self.root}/{build}/manifest")
        publish(spark, self.root, build)


def run(changed: DataFrame, table: UpsertTable, checkpoint: str) -> None:
    """Let a streaming frame of changed rows take what is there into the table, and stop."""
    changed.writeStream.foreachBatch(table.write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
