"""The hash snapshot: digests of files seen before, keyed by path and what identifies a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

VERSION = ("size", "mtime_ns", "inode", "device")
VALUES = ("partial", "full", "perceptual", "perceptual_algo")
SCHEMA = (
    "path string, size long, mtime_ns long, inode long, device long, partial string, "
    "full string, perceptual string, perceptual_algo string"
)

NONE_YET = "no hash snapshot yet"


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, str | None]:
    """The snapshot, and a warning in place of one that can't be read."""
    try:
        rows = store.read(spark, folder, SCHEMA)
        if rows is None:
            return spark.createDataFrame([], SCHEMA), NONE_YET
        rows.isEmpty()
        return rows, None
    except Exception as problem:
        return spark.createDataFrame([], SCHEMA), f"hash snapshot unavailable: {type(problem).__name__}"


def hits(files: DataFrame, snapshot: DataFrame, algo: str | None = None) -> DataFrame:
    """Files with the digests known of this very version; others have nulls.

    Perceptual hashes count only if the algorithm's stamp matches.
    """
    known = snapshot.select("path", *[F.col(c).alias(f"known_{c}") for c in (*VERSION, *VALUES)])
    same = F.lit(True)
    for c in VERSION:
        same = same & (F.col(c) == F.col(f"known_{c}"))
    stamped = F.col("known_perceptual_algo") == F.lit(algo)
    columns = [F.when(same, F.col(f"known_{c}")).alias(c) for c in ("partial", "full")]
    columns.append(F.when(same & stamped, F.col("known_perceptual")).alias("perceptual"))
    return files.join(known, "path", "left").select(*files.columns, *columns)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot with new rows: added to those of the same version, in place of others."""
    o, n = old.alias("o"), new.alias("n")
    same = F.lit(True)
    for c in VERSION:
        same = same & (F.col(f"o.{c}") == F.col(f"n.{c}"))
    there = F.col("n.path").isNotNull()
    columns = [F.coalesce("n.path", "o.path").alias("path")]
    columns += [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in VERSION]
    for c in VALUES:
        both = F.when(same, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"n.{c}"))
        columns.append(F.when(there, both).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(*columns)


def save(rows: DataFrame, folder: str) -> None:
    """A new version of the snapshot, which ``rows`` may come from."""
    store.publish(rows, folder)
