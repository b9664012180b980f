"""Grouping by stages: each adds a key, and only rows that share all keys so far go on to a costly one.

A stage takes a DataFrame and gives it one more column.  Keys that rows have from the start
cost nothing, so that no semi join stands between them: the planner puts one join in front of each stage that
has work to do, over all keys found before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Writes a stage's rows and says so to whoever watches.
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class GroupingStage:
    """``compute`` gives rows the column ``key`` and ``error``, null where it went well; None where rows have the key."""

    key: str
    compute: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Refined:
    """``rows`` share all keys with another one; ``skipped`` (path, reason); ``computed`` has each costly stage's good rows."""

    rows: DataFrame
    skipped: DataFrame
    computed: dict[str, DataFrame]


def shared_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return rows.join(several, list(keys), "left_semi")


def refine(rows: DataFrame, stages: Sequence[GroupingStage], keep: Keep) -> Refined:
    keys: list[str] = []
    failed, computed, open_keys = [], {}, False
    for stage in stages:
        if stage.compute is None:
            keys.append(stage.key)
            open_keys = True
            continue
        if keys:
            rows = shared_keys(rows, keys)
        found = keep(stage.compute(rows), stage.key)
        failed.append(found.where("error is not null").select("path", F.col("error").alias("reason")))
        rows = computed[stage.key] = found.where("error is null").drop("error")
        keys.append(stage.key)
        open_keys = False
    if open_keys:
        rows = shared_keys(rows, keys)
    if not failed:
        failed = [rows.select("path", F.lit("").alias("reason")).limit(0)]
    return Refined(rows, reduce(DataFrame.unionByName, failed), computed)
