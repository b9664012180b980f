"""What a scan reports: JSON rows, text tables, an action log."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import human_size


def exact_json(members: DataFrame) -> DataFrame:
    """(group_id, json): one object per group with its files in path order, verdicts where there are any, and their hard links."""
    known = [x for x in ("verdict", "reason") if x in members.columns]
    files = F.array_sort(F.collect_list(F.struct("path", "size", "mtime_ns", *known)))
    links = F.array_sort(F.flatten(F.collect_list("links")))
    grouped = members.groupBy("group_id", "hash", "size").agg(files.alias("files"), F.count("*").alias("n"), links.alias("hardlinked"))
    shape = F.struct("hash", "size", (F.col("size") * (F.col("n") - 1)).alias("reclaimable"), "files", "hardlinked")
    return grouped.select("group_id", F.to_json(shape).alias("json"))


def similar_json(members: DataFrame) -> DataFrame:
    """The same for similar groups, best member first; similarities to four places."""
    row = F.struct(
        "rank", "path", "size", "mtime_ns", "width", "height", "distance", F.round("similarity", 4).alias("similarity"),
        "aliases", "verdict", "reason",
    )
    freed = F.sum(F.when(F.col("rank") > 1, F.col("size")).otherwise(0))
    grouped = members.groupBy("group_id").agg(F.array_sort(F.collect_list(row)).alias("members"), freed.alias("reclaimable"))
    shape = F.struct(F.col("group_id").alias("id"), "reclaimable", "members")
    return grouped.select("group_id", F.to_json(shape).alias("json"))


def hidden_json(items: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_dir"), "folder").otherwise("file").alias("type")
    row = F.struct("path", kind, "size", "category", "protected", F.col("home_dot").alias("home_toplevel_dot"), "preselect")
    return items.select("path", F.to_json(row).alias("json"))


def table(members: DataFrame) -> DataFrame:
    """Lines of a printed table: hash, verdict, size, path."""
    return members.select(
        F.substring("hash", 1, 12).alias("hash"), "verdict", human_size(F.col("size")).alias("size"), "path", "reason"
    ).orderBy("hash", "path")


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of one column ``json``, objects of the columns, in their order; a single column stands for itself."""
    value = F.to_json(F.struct(*columns))
    if len(columns) == 1:  # to_json takes no bare texts
        value = F.regexp_extract(value, r"(?s)^\{\"[^\"]*\":(.*)\}$", 1)
    return rows.orderBy(*columns).select(value.alias("json"))


@dataclass
class Grouped:
    """Groups to be written member by member: ``rows`` has (place, section, at, json), section 0 opens a group.

    Sections from 1 on are the lists of a group, named by ``sections``; ``place`` orders groups and ``at`` members.
    """

    rows: DataFrame
    sections: tuple[str, ...]


def _row(section: int, at: Column, text: Column, place: Column) -> list[Column]:
    return [place.alias("place"), F.lit(section).alias("section"), at.alias("at"), text.alias("json")]


def exact_groups(members: DataFrame) -> Grouped:
    """What ``exact_json`` says of each group, but no row holds a group, however many members it has."""
    place, path = F.col("group_id"), F.col("path")
    heads = members.groupBy("group_id", "hash", "size").agg((F.col("size") * (F.count("*") - 1)).alias("reclaimable"))
    known = [x for x in ("verdict", "reason") if x in members.columns]
    files = members.select(*_row(1, path, F.to_json(F.struct("path", "size", "mtime_ns", *known)), place))
    links = members.select("group_id", F.explode("links").alias("link")).select(*_row(2, F.col("link"), F.to_json(F.array("link")), place))
    links = links.withColumn("json", F.expr("substring(json, 2, length(json) - 2)"))
    rows = heads.select(*_row(0, F.lit(""), F.to_json(F.struct("hash", "size", "reclaimable")), place)).unionByName(files).unionByName(links)
    return Grouped(rows, ("files", "hardlinked"))


def similar_groups(members: DataFrame, order: DataFrame) -> Grouped:
    """The same for similar groups, best member first; ``order`` has (group_id, place)."""
    row = F.struct(
        "rank", "path", "size", "mtime_ns", "width", "height", "distance", F.round("similarity", 4).alias("similarity"), "aliases", "verdict", "reason",
    )
    freed = F.sum(F.when(F.col("rank") > 1, F.col("size")).otherwise(0)).alias("reclaimable")
    heads = members.groupBy(F.col("group_id").alias("id")).agg(freed).join(order.withColumnRenamed("group_id", "id"), "id")
    rank = F.lpad(F.col("rank").cast("string"), 12, "0")
    own = members.join(order, "group_id").select(*_row(1, rank, F.to_json(row), F.col("place")))
    return Grouped(heads.select(*_row(0, F.lit(""), F.to_json(F.struct("id", "reclaimable")), F.col("place"))).unionByName(own), ("members",))


def _write_groups(write, groups: Grouped) -> None:
    section = -1

    def through(to: int) -> None:
        """Close the open list, and write those up to ``to`` that have nothing in them."""
        nonlocal section
        while section < to:
            write((", " if section == 0 else "], ") + f"{json.dumps(groups.sections[section])}: [")
            section += 1

    for row in groups.rows.orderBy("place", "section", "at").toLocalIterator():
        if row["section"] == 0:
            if section >= 0:
                through(len(groups.sections))
                write("]}")
            write((",\n " if section >= 0 else "\n ") + row["json"][:-1])
            section = 0
            continue
        first = section < row["section"]
        through(row["section"])
        write(("" if first else ", ") + row["json"])
    if section >= 0:
        through(len(groups.sections))
        write("]}")


def write_document(write, head: dict[str, object], lists: dict[str, DataFrame | Grouped]) -> None:
    """One JSON document, its long lists (column ``json``, or groups) one partition after the other."""
    parts = [f"{json.dumps(k)}: {json.dumps(v)}" for k, v in head.items()]
    write("{" + ", ".join(parts))
    for number, (name, rows) in enumerate(lists.items()):
        write(("," if number or parts else "") + f"\n{json.dumps(name)}: [")
        if isinstance(rows, Grouped):
            _write_groups(write, rows)
        else:
            for place, row in enumerate(rows.toLocalIterator()):
                write((",\n " if place else "\n ") + row["json"])
        write("]")
    write("}\n")


#: Columns of the action log; each record also has ``ts``, its time in UTC to the second.
LOG = "ts string, action string, kind string, path string, size long, hash string, status string, detail string, linked_to string"


def append_log(records: DataFrame, folder: str) -> None:
    """Results of actions as JSON lines, added to those before; an attempt that fails leaves no records."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    records.select(now.alias("ts"), "*").write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(folder)


def summary_text(summary: DataFrame, examples: DataFrame, mode: str = "trash", dry: bool = True) -> str:
    """A few lines on what was or would be done; statuses are few and examples ten each."""
    verb = {"trash": "moved to Trash", "permanent": "deleted permanently", "hardlink": "replaced with hard links"}[mode]
    rows = {x["status"]: x for x in summary.withColumn("human", human_size(F.col("freed"))).collect()}
    good = rows.get("would act" if dry else "done")
    n, freed = (good["n"], good["human"]) if good else (0, "0 B")
    lines = ["Dry run: nothing was changed."] * dry + [f"{n} files {'would be ' * dry}{verb}, freeing {freed}."]
    shown = examples.collect()
    for status, row in sorted(rows.items()):
        if good is not None and status == good["status"]:
            continue
        own = [x for x in shown if x["status"] == status]
        lines.append(f"{row['n']} skipped or failed ({status}):")
        lines += [f"  {x['path']}" + (f": {x['detail']}" if x["detail"] else "") for x in own]
        lines += [f"  ... and {row['n'] - len(own)} more"] * (row["n"] > len(own))
    return "\n".join(lines)
