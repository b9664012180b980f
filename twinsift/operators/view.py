"""The view algebra over groups: filters, orders, statuses, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import base, exact, keep

SORTS = ("reclaimable", "size", "count", "name", "path")


def by_type(members: DataFrame, kind: str) -> DataFrame:
    """All members of the groups of which any file is of this category."""
    some = members.where(paths.category(F.col("path")) == kind).select("group_id").distinct()
    return members.join(some, "group_id", "left_semi")


def by_text(members: DataFrame, text: str) -> DataFrame:
    """All members of the groups of which any path holds the text, whatever its case."""
    needle = text.strip().lower()
    if not needle:
        return members
    some = members.where(F.contains(F.lower("path"), F.lit(needle))).select("group_id").distinct()
    return members.join(some, "group_id", "left_semi")


def _with_names(members: DataFrame) -> DataFrame:
    names = members.groupBy("group_id").agg(
        F.min(F.lower(paths.name(F.col("path")))).alias("first_name"), F.min(F.lower("path")).alias("first_lower_path")
    )
    return exact.groups(members).join(names, "group_id")


def _order(sort: str) -> list[Column]:
    orders: dict[str, list[Column]] = {
        "reclaimable": [F.desc("reclaimable"), F.col("hash")],
        "size": [F.desc("size"), F.desc("reclaimable"), F.col("hash")],
        "count": [F.desc("n_files"), F.desc("reclaimable"), F.col("hash")],
        "name": [F.col("first_name"), F.col("hash")],
        "path": [F.col("first_lower_path"), F.col("hash")],
    }
    return [*orders[sort], F.col("group_id")]


def ordered(members: DataFrame, sort: str = "reclaimable") -> DataFrame:
    """Groups with their sort keys, in order."""
    return _with_names(members).orderBy(*_order(sort))


def places(members: DataFrame, *sorts: str) -> DataFrame:
    """(sort, group_id, place): each group's place, from 0, in each of the orders (all of them, if none is named)."""
    groups = base.checkpointed(_with_names(members))
    found = [
        base.numbered(groups, _order(sort), "place").select(F.lit(sort).alias("sort"), "group_id", "place") for sort in sorts or SORTS
    ]
    return reduce(DataFrame.unionByName, found)


def representatives(members: DataFrame) -> DataFrame:
    """(group_id, representative) of groups with an image: its first image file."""
    images = paths.category(F.col("path")) == "Images"
    return members.groupBy("group_id").agg(
        F.min(F.when(images, F.col("path"))).alias("image"), F.min("path").alias("first")
    ).where("image is not null").select("group_id", F.coalesce("image", "first").alias("representative"))


def _overridden(recommended: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows with ``selected`` of their path; a path that is overridden more than once is selected only if all say so."""
    return recommended.join(overrides.groupBy("path").agg(F.min("selected").alias("selected")), "path", "left")


def statuses(recommended: DataFrame, overrides: DataFrame, protected: Column) -> DataFrame:
    """(group_id, path, checked, status): overrides (path, selected) go before recommendations."""
    joined = _overridden(recommended, overrides)
    checked = ~protected & F.coalesce("selected", F.col("verdict") == "delete")
    status = F.when(protected, "protected").when(checked, "delete").otherwise("keep")
    return joined.select("group_id", "path", "size", checked.alias("checked"), status.alias("status"))


def similar_statuses(recommended: DataFrame, overrides: DataFrame, protected: Column) -> DataFrame:
    """(group_id, path, checked, status, suggestion): only what was overridden is checked, advice is beside it."""
    joined = _overridden(recommended, overrides)
    checked = ~protected & F.coalesce("selected", F.lit(False))
    status = F.when(protected, "protected").when(checked, "delete").otherwise("keep")
    return joined.select("group_id", "path", "size", checked.alias("checked"), status.alias("status"), F.col("verdict").alias("suggestion"))


def similar_groups(recommended: DataFrame) -> DataFrame:
    """(group_id, n, reclaimable, place): what all but each group's best free, most first."""
    freed = F.sum(F.when(F.col("rank") > 1, F.col("size")).otherwise(0))
    groups = recommended.groupBy("group_id").agg(F.count("*").alias("n"), freed.alias("reclaimable"))
    return keep.numbered(groups, [F.desc("reclaimable"), F.col("group_id")], "place")


def similar_totals(recommended: DataFrame) -> DataFrame:
    freed = F.sum(F.when(F.col("rank") > 1, F.col("size")).otherwise(0))
    return recommended.agg(F.count_distinct("group_id").alias("n_groups"), F.count("*").alias("n_images"), F.coalesce(freed, F.lit(0)).alias("reclaimable"))


def shown_time(mtime_ns: Column) -> Column:
    """A modification time to the minute, in the session's zone."""
    return F.date_format(F.timestamp_seconds(F.floor(mtime_ns / 1_000_000_000)), "yyyy-MM-dd HH:mm")


def selection(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("checked").alias("n_selected"), F.coalesce(F.sum(F.when(F.col("checked"), F.col("size"))), F.lit(0)).alias("selected_size"))
