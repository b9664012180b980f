"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard scores every key by -weight / ln(u), u being a hash of key and shard scaled to
(0, 1); the best score gets the record.  Another shard changes no other's score, so that it
takes records only into itself; a shard that goes gives away only its own.

A null key is read as a key of its own; a null text has no bytes, a long one all of its own.  Rows
with the same key share a shard.  An empty table gives an empty result.  Columns other than key
and text are left out, whatever their names.

Slots count the rows of a shard from 0.  A shard's rows are cut into ``parts`` by another
hash, numbered within a part in order of key, checksum and size, and moved up by what the
parts before hold: no task sorts a shard, and the numbers are the same in every run.  Rows that
are equal in all of these are counted, numbered as one and dealt out again in pieces, so
that neither does a key that holds a third of all rows burden one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: So many shards' parts, of 24 bytes each, are small enough to send to every executor.
FEW_PARTS = 1 << 18
#: Rows that one step makes from a row that stands for many equal ones.
PIECE = 100_000


def score(key: Column, shard: int, weight: float) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10)
    unit = (draw.cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(unit)


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that scores the key highest, the smallest of equals."""
    scored = [
        F.struct(score(key, n, w).alias("score"), F.lit(-n).alias("n"))
        for n, w in enumerate(weights)
        if w > 0
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["n"]).cast("int")


def shard(
    df: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 4096,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard); ``grown`` weighs one more shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        best_shard(key, weights).alias("shard"),
        best_shard(key, [*weights, grown]).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(raw)), F.lit(parts)).alias("part"),
    )
    classes = checkpointed(rows.groupBy(*rows.columns).agg(F.count("*").alias("many")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        classes.groupBy("shard", "part")
        .agg(F.sum("many").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    if len(weights) * parts <= FEW_PARTS:  # one row for each shard and part, whatever the input
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        classes.withColumn("first", F.coalesce(F.sum("many").over(inside), F.lit(0)))
        .join(offsets, ["shard", "part"])
        .withColumn("first", F.col("first") + F.col("offset"))
    )
    few = placed.where(F.col("many") <= PIECE)
    pieces = F.expr(f"sequence(0, (many - 1) div {PIECE})")
    hot = placed.where(F.col("many") > PIECE).select("*", F.explode(pieces).alias("piece")).repartition("id", "piece")
    hot = hot.withColumns({
        "first": F.col("first") + F.col("piece") * PIECE, "many": F.least(F.lit(PIECE), F.col("many") - F.col("piece") * PIECE),
    }).drop("piece")
    every = few.unionByName(hot)
    return every.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.expr("sequence(first, first + many - 1)")).alias("slot"),
        "grown_shard",
    )
