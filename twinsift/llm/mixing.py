"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document gets a stable hash of its id and text.  Sizes are summed by source and
leading hash bits; in each source the bucket in which the budget runs out is refined by
the next bits, and only that bucket.  What lies below the threshold is taken once more.
Thresholds are nested: a larger budget takes all that a smaller one takes.

Null texts have size 0 and are never taken.  A null source is a source of its own, the
last.  Rows with the same source, id and text have the same hash; where the budget runs out
inside such a hash, as many of its rows are taken as come nearest to the budget (in order of a hash
over all columns; equal rows stand for each other, so that reruns agree).  Long texts count
like others, in one pass of the expression.  An empty table gives an empty result.  Other columns
of the input are left out, whatever their names.

Everything is DataFrame operations.  What is shuffled is one number for each source and
bucket, and a narrow row (no text) for each document; both are dealt by source and bucket,
so that a source with most of the rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed

#: Bits of the hash, and those that one histogram tells apart.
BITS, LEVEL_BITS = 60, 12
MOST_TIMES = 3
#: So many sources' plans, of some 100 bytes each, are small enough to send to every executor.
FEW_SOURCES = 50_000
#: Rows that one step makes from a row that stands for many equal ones.
PIECE = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stable_hash(id_col: str, text_col: str) -> Column:
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _bucket(level: int) -> Column:
    shift = BITS - LEVEL_BITS * (level + 1)
    return F.shiftright("h", shift).bitwiseAND((1 << LEVEL_BITS) - 1)


def targets(sizes: DataFrame, weights: Sequence[float], most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) to which target, whole repeats and the rest to take are added.

    Each source gets its weight's share of all sizes, ``most`` times its own size at most;
    the level at which the shares fill up with what others can't take is found from
    running sums, sources in the order in which they reach their bounds.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        ((F.col("place") - 1) % len(weights) + 1).cast("int"),
    )
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy("reach", "place")
    so_far = by_bound.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_source))
        .withColumn("weight", weight)
        .withColumn("bound", (F.lit(most) * F.col("source_size")).cast("double"))
        .withColumn("reach", F.col("bound") / F.col("weight"))
    )
    filled = (
        ranked.withColumn("bound_before", F.sum("bound").over(so_far) - F.col("bound"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(so_far) + F.col("weight"))
        .withColumn("all_sizes", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("all_sizes") - F.col("bound_before")) / F.col("weight_left"))
        # the first source that the level doesn't fill to its bound sets the level
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(whole)["level"])
    )
    target = F.least(F.col("bound"), F.col("level") * F.col("weight"))
    times = F.least(F.floor(target / F.col("source_size")), F.lit(most)).cast("long")
    return (
        filled.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("times", F.coalesce(F.when(F.col("source_size") > 0, times), F.lit(0)))
        .withColumn("budget", F.when(F.col("times") < most, F.col("target") - F.col("times") * F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "times", "budget")
    )


def _edge(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of each source the bucket in which its budget runs out: (source, path, b, n, m, budget).

    ``budget`` comes back as what is left of it at the bucket's beginning.
    """
    so_far = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(so_far), F.lit(0))
    return (
        histogram.withColumn("before", before)
        .alias("h")
        .join(budgets.alias("p"), F.col("h.source").eqNullSafe(F.col("p.source")))
        .where("before <= budget and budget < before + n")
        .select("h.source", "path", "b", "n", "m", (F.col("budget") - F.col("before")).alias("budget"))
    )


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"),
        stable_hash(id_col, text_col).alias("h"),
        *more,
    )


def thresholds(docs: DataFrame, weights: Sequence[float], most: int = MOST_TIMES) -> DataFrame:
    """Of each source what all its documents are taken, and below which hash once more.

    ``tied`` rows have the threshold itself, ``extra`` of them are taken once more.
    ``docs`` has (source, size, h), best checkpointed: it is read several times.
    """
    histogram = docs.groupBy("source", _bucket(0).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    sizes = histogram.groupBy("source").agg(F.sum("n").alias("source_size"))
    plan = checkpointed(targets(sizes, weights, most))
    edge = _edge(histogram, plan.select("source", "budget", F.lit(0).cast("long").alias("path")))
    open_docs = docs
    for level in range(1, BITS // LEVEL_BITS):
        edge = checkpointed(edge)
        here = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.b") == F.col("e.b"))
        kept = open_docs.withColumn("b", _bucket(level - 1)).alias("d").join(edge.alias("e"), here)
        open_docs = checkpointed(kept.select("d.source", "d.size", "d.h"))
        deeper = open_docs.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        path = (F.col("path") * (1 << LEVEL_BITS) + F.col("b")).alias("path")
        edge = _edge(deeper, edge.select("source", "budget", path))
    # rows of one hash have one text, so one size: n / m
    extra = F.floor(F.col("budget") * F.col("m") / F.col("n") + 0.5)
    last = edge.select(
        F.col("source").alias("at"),
        (F.col("path") * (1 << LEVEL_BITS) + F.col("b")).alias("threshold"),
        F.col("m").alias("tied"),
        F.least(F.col("m"), extra).cast("long").alias("extra"),
    )
    return checkpointed(
        plan.join(last, F.col("source").eqNullSafe(F.col("at")), "left").select(
            "source", "source_size", "target", "times", "threshold", "tied", "extra"
        )
    )


def taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with source_size, target and ``repeats``: how often the mix takes each row.

    The join is on the source.  The plan has one row for each: up to ``FEW_SOURCES`` rows are
    counted and then broadcast, so that no document is shuffled; beyond, both sides are
    shuffled and skewed partitions are split at run time.
    """
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    splits = not plan.where("0 < extra and extra < tied").isEmpty()
    plan = plan.withColumnRenamed("source", "planned")
    plan = F.broadcast(plan) if few else plan
    at_edge = F.coalesce(F.col("h") == F.col("threshold"), F.lit(False))
    once_more = F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)) | (at_edge & (F.col("extra") == F.col("tied")))
    repeats = F.when(F.col("size") > 0, F.col("times") + once_more.cast("long")).otherwise(F.lit(0))
    split = at_edge & F.coalesce(F.expr("0 < extra and extra < tied"), F.lit(False))
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("planned"))).withColumn("repeats", repeats.cast("long"))
    spent = ("planned", "times", "threshold", "tied", "extra", "h")
    if not splits:
        return joined.drop(*spent)
    rows = [F.col(x) for x in docs.columns]
    rows += [x.isNull() for x in rows]  # a null leaves a hash as it is
    key = [F.xxhash64(*rows).alias("key_a"), F.xxhash64(F.lit(1), *rows).alias("key_b")]
    classes = checkpointed(
        joined.where(split).select("*", *key).groupBy("key_a", "key_b")
        .agg(F.first(F.struct(*joined.columns)).alias("one"), F.count("*").alias("m"))
        .select("one.*", "key_a", "key_b", "m")
    )
    so_far = Window.partitionBy("planned").orderBy("key_a", "key_b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(so_far), F.lit(0))
    counted = classes.select("key_a", "key_b", "m", "planned", "extra").select(
        "key_a", "key_b", F.least(F.col("m"), F.greatest(F.lit(0), F.col("extra") - before)).alias("more")
    )
    each = _numbered(classes.join(counted, ["key_a", "key_b"]), "m", "number").withColumn(
        "repeats", F.col("times") + (F.col("number") < F.col("more")).cast("long")
    )
    return joined.where(~split).drop(*spent).unionByName(each.drop("number", "more", "m", "key_a", "key_b", *spent))


def _numbered(rows: DataFrame, many: str, number: str) -> DataFrame:
    """Each row as often as ``many`` says, numbered from 0; large numbers are dealt to all tasks in pieces."""
    piece = rows.select("*", F.explode(F.expr(f"sequence(0, ({many} - 1) div {PIECE})")).alias("piece"))
    first, last = f"piece * {PIECE}", f"least({many}, (piece + 1) * {PIECE}) - 1"
    return piece.repartition(F.col("piece")).select("*", F.explode(F.expr(f"sequence({first}, {last})")).alias(number)).drop("piece")


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = MOST_TIMES,
) -> DataFrame:
    """(id, source, size, source_size, target, repeats) of every document."""
    docs = checkpointed(sized(df, id_col, text_col, source_col))
    return taken(docs, thresholds(docs, weights, most)).withColumnRenamed("id", id_col)


def mixed_documents(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = MOST_TIMES,
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Texts are not shuffled to be mixed: their hashes are computed anew where they are read.
    """
    row = F.struct("*").alias("row")
    docs = checkpointed(sized(df, id_col, text_col, source_col))
    plan = thresholds(docs, weights, most)
    found = taken(sized(df, id_col, text_col, source_col, row), plan)
    copies = F.explode(F.expr("sequence(1, cast(repeats as int))"))
    return found.where("repeats > 0").select("row", copies).select("row.*")
