"""What several operators need: the shared folder, places in a total order, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoints(spark: SparkSession) -> str:
    """Rounds are written to the folder of ``spark.checkpoint.dir``; if unset, a local master gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="twinsift-"))
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    ensure_checkpoints(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, order: Sequence[Column], column: str) -> DataFrame:
    """Rows with their place, from 0, in a total order: sorted by ranges, then moved up by what stands before.

    No task holds all rows; the sorted rows are written to the checkpoint folder, so that
    their places stay.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before")
    )
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, at.alias(column))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b), given in both directions, reaches.

    Labels pass to neighbours and then jump to their own labels, so that rounds grow with the logarithm
    of the longest path.
    """
    edges = checkpointed(edges.select("a", "b"))
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("next"))
        moved = checkpointed(lower.join(jump, "via").select("node", "old", F.least("via", "next").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels
