"""Versioned Parquet tables: a version counts once its job has committed, and readers take the newest.

A new version is written beside the old ones, so that a table may be derived from itself and a crash
at any point leaves a whole one.  Folders are named through Hadoop's file systems, wherever they are.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a job leaves in a folder when all of its tasks have committed.
COMMITTED = "_SUCCESS"


def _system(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions of a table, oldest first; none if it doesn't exist."""
    system, path = _system(spark, folder)
    if not system.exists(path):
        return []
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [x.getPath() for x in system.listStatus(path) if x.isDirectory() and x.getPath().getName().startswith("v")]
    return sorted((x.toString() for x in found if system.exists(new(x, COMMITTED))), key=lambda x: x.rsplit("/", 1)[1])


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """The newest version, None if there is none."""
    there = versions(spark, folder)
    return spark.read.schema(schema).parquet(there[-1]) if there else None


def publish(rows: DataFrame, folder: str, keep: int = 1) -> str:
    """Write a new version; of the older ones ``keep`` stay, for those who still read them."""
    spark = rows.sparkSession
    old = versions(spark, folder)
    new = f"{folder}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(new)
    system, _ = _system(spark, folder)
    for path in old[: max(0, len(old) - keep)]:
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
    return new
