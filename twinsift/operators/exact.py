"""Exact duplicates: sizes, hard links, partial and full digests, groups.

Every file becomes one narrow row first: its digests are computed where it is read, so that
contents are never shuffled.  Groups are aggregates joined back to rows rather than windows
or lists: a group that holds a third of all files is summed before the shuffle, and
the join back to it can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

NARROW = ("path", "size", "mtime_ns", "inode", "device")


def digested(files: DataFrame) -> DataFrame:
    """Metadata with ``partial`` and ``full`` digests in place of ``content``."""
    return files.select(
        *NARROW,
        paths.partial_digest(F.col("content")).alias("partial"),
        F.sha2(F.col("content").cast("binary"), 256).alias("full"),
    )


def empty_files(files: DataFrame) -> DataFrame:
    return files.where("size = 0")


def shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys at least one other row has too; rows with a null key go."""
    known = rows.dropna(subset=list(keys))
    common = known.groupBy(*keys).agg(F.count("*").alias("sharing")).where("sharing > 1")
    return known.join(common, list(keys))


def size_buckets(files: DataFrame) -> DataFrame:
    """(size, n) of the sizes that at least two files have."""
    return files.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).where("n > 1")


def collapse_links(files: DataFrame) -> DataFrame:
    """One row for each file of a size: the smallest path stands for all its hard links."""
    by_file = files.groupBy("size", "device", "inode").agg(
        F.min_by(F.struct(*[c for c in files.columns if c not in ("size", "device", "inode")]), "path").alias("first"),
        F.array_sort(F.collect_list("path")).alias("all_paths"),
    )
    return by_file.select(
        "size", "device", "inode", "first.*", F.slice("all_paths", F.lit(2), F.size("all_paths")).alias("links")
    )


def hardlink_sets(files: DataFrame) -> DataFrame:
    """(device, inode, paths): files with several paths, in the order of components."""
    in_order = F.array_sort(F.collect_list(F.struct(paths.components(F.col("path")).alias("c"), F.col("path").alias("p"))))
    return (
        files.where("size > 0").groupBy("device", "inode").agg(in_order.alias("x"))
        .where(F.size("x") > 1)
        .select("device", "inode", F.transform("x", lambda y: y["p"]).alias("paths"))
    )


def group_files(files: DataFrame, *more: str) -> DataFrame:
    """(group_id, hash, path, size, ...) of each file in a group of equal content.

    ``more`` are further columns that must be equal (``content`` for byte comparison).  A
    group's id is its digest and its first path, as two groups may share a digest.
    """
    return grouped(collapse_links(files.where("size > 0")), *more)


def grouped(single: DataFrame, *more: str) -> DataFrame:
    """The same from rows that already stand for all their links."""
    keys = ["size", "partial", "full", *more]
    groups = (
        single.dropna(subset=keys).groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
        .where("n > 1")
    )
    return single.join(groups, keys).select(
        F.concat_ws("|", F.substring("full", 1, 12), "first_path").alias("group_id"),
        F.col("full").alias("hash"), "path", "size", "mtime_ns", "inode", "device", "links",
    )


def groups(members: DataFrame) -> DataFrame:
    """(group_id, hash, size, n_files, n_links, reclaimable)."""
    return members.groupBy("group_id", "hash", "size").agg(
        F.count("*").alias("n_files"), F.sum(F.size("links")).alias("n_links")
    ).withColumn("reclaimable", F.col("size") * (F.col("n_files") - 1))


def totals(files: DataFrame, members: DataFrame) -> DataFrame:
    scanned = files.agg(F.count("*").alias("files_scanned"))
    found = groups(members).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))
    return scanned.join(F.broadcast(found))  # one row each
