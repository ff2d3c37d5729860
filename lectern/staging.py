"""Intermediate tables in the shared folder, and versions of published ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder under the shared one that no other call uses."""
    return f"{shared_folder(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: what reads it twice doesn't compute it twice, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, build) of everything published under root, the oldest first."""
    folder, fs = _path(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    return sorted((int(n), build) for n, build in (s.getPath().getName().split("-", 1) for s in fs.listStatus(folder)))


def publish(spark: SparkSession, root: str, build: str) -> int:
    """Make the folder root/build the current version: one new, empty pointer file, so that a reader sees the old version or the new one.

    Publishing the current build again changes nothing. Of writers that meet, each gets a number of its own.
    """
    while True:
        known = versions(spark, root)
        if known and known[-1][1] == build:
            return known[-1][0]
        number = known[-1][0] + 1 if known else 1
        path, fs = _path(spark, f"{root}/versions/{number:09d}-{build}")
        fs.create(path, False).close()
        if sum(n == number for n, _ in versions(spark, root)) == 1:
            return number
        fs.delete(path, False)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest version, or None."""
    known = versions(spark, root)
    return f"{root}/{known[-1][1]}" if known else None
