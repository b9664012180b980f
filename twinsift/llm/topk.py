"""Exact top-k by inner product without random access: sorted lists and bounds.

Candidates lie in blocks.  In a block every dimension is a list sorted by component.  A query
reads each list sequentially from the end that its own component prefers, the next stretch of
all lists at a time.  A candidate seen in some lists has a lower bound (what it was seen
with, and the list's worst elsewhere) and an upper bound (the value last read elsewhere).  When no
candidate that was never seen can reach the k-th best lower bound, reading stops, and the
candidates whose upper bound reaches it get their final scores.  Stretches double; all queries
of a block read on together, as matrix products.

Queries (a stated set) meet all candidates block by block: never as single rows, and no
side is broadcast.  A task holds one block of each.  Each pair of blocks keeps k rows of
a query at most, and the best k of these are the result.

Vectors that are null or hold nulls, NaN or infinities take no part; short ones are read
as if filled up with zeros.  Rows are told apart by themselves, not by their ids: every row that
is a query is asked, also if its id occurs again, and all other rows are its candidates, those
of its own id and those without an id too.  Equal rows (id and vector) are searched once and
counted.  Ties go to the smaller id, a null id last.  Scores beyond 64 bits are cut to what 64 bits
hold.  An empty table gives an empty result.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8_192, 512
SCALE = 1024


def _exact(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of all rows; as floats where they are exact, else as Python's integers."""
    most = np.abs(values).max(initial=0) * np.abs(others).max(initial=0) * values.shape[1]
    if most < 2**53:
        return (values @ others.T).astype(np.int64)
    big = [[int(x) for x in row] for row in others]
    out = [[sum(int(a) * b for a, b in zip(row, other)) for other in big] for row in values]
    return np.array(out, dtype=object)


def search(
    queries: np.ndarray, own: np.ndarray, rows: np.ndarray, places: np.ndarray, many: np.ndarray, k: int
) -> tuple[list, list, list, list[float]]:
    """(queries, rows, scores, depths): for each query the rows of this block that can be its k best.

    ``own`` is each query's own row or -1; ``places`` orders rows of equal scores, and ``many`` says
    how often each occurs (the query itself doesn't count).
    """
    n, wide = rows.shape
    if not n or not len(queries):
        return [], [], [], []
    order = np.argsort(rows, 0, kind="stable")
    rank = np.empty((n, wide), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], 0)
    ranked = np.take_along_axis(rows, order, 0)
    # what doubles may round off
    slack = 4 * wide * wide * np.finfo(float).eps * np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    worst = up * ranked[0] + down * ranked[-1]
    out_q, out_r, out_s, depths = [], [], [], [1.0] * len(queries)
    waiting, depth = np.arange(len(queries)), max(1, n // 8)
    while len(waiting):
        high, low = rank >= n - depth, rank < depth
        p, m = up[waiting], down[waiting]
        edge = p * ranked[n - depth] + m * ranked[depth - 1]
        both = np.hstack([high, low]).astype(float)
        lower = np.hstack([np.where(high, rows, 0), np.where(low, rows, 0)]) @ np.hstack([p, m]).T
        rises = np.hstack([queries[waiting] > 0, queries[waiting] < 0])
        # of the lists in which a candidate was seen, what the bounds assume elsewhere
        upper = lower + edge.sum(1) + slack - both @ (np.tile(edge, 2) * rises).T
        lower += worst[waiting].sum(1) - slack - both @ (np.tile(worst[waiting], 2) * rises).T
        alone = np.flatnonzero((own[waiting] >= 0) & (many[own[waiting]] == 1))
        lower[own[waiting[alone]], alone] = -np.inf
        enough = min(k, n)
        bar = np.partition(lower, n - enough, 0)[n - enough]  # more of a repeated row only raise it
        stops = (edge.sum(1) + slack < bar) | (depth >= n)
        for j in np.flatnonzero(stops).tolist():
            q = int(waiting[j])
            able = np.flatnonzero(upper[:, j] >= bar[j])
            held = many[able] - (able == own[q])
            able, held = able[held > 0], held[held > 0]
            score = _exact(rows[able], queries[q : q + 1])[:, 0]
            best = np.lexsort((places[able], -score))
            through = best[np.cumsum(held[best]) - held[best] < k]
            out_q += [q] * len(through)
            out_r += able[through].tolist()
            out_s += score[through].tolist()
            depths[q] = depth / n
        waiting, depth = waiting[~stops], min(n, 2 * depth)
    return out_q, out_r, out_s, depths


def _matrix(packed: pd.Series) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, id, score) of every query's k best rows."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = df.where(F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"), parts.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = rows.groupBy("id", "x").agg(F.count("*").alias("many"), F.max("asks").alias("asks"))
    rows = checkpointed(rows.withColumn("key", F.xxhash64("id", F.col("id").isNull(), "x")))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    n_rows, n_asks = max(1, -(-sizes["n"] // CANDIDATES)), max(1, -(-sizes["q"] // QUERIES))
    row = ("key", "id", "x", "many")
    held = rows.select(
        *row,
        F.pmod("key", F.lit(n_rows)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))).alias("ask_block"),
    )
    asked = rows.where("asks").select(
        *row,
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("block"),
        F.pmod(F.shiftright("key", 20), F.lit(n_asks)).cast("int").alias("ask_block"),
    )

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, r = _matrix(a["x"]), _matrix(b["x"])
        wide = max(q.shape[1], r.shape[1])
        q, r = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, r))
        # equal rows are one here, so that id and vector tell a query's own row
        place = {x: i for i, x in enumerate(zip(b["id"].fillna(0), b["id"].isna(), map(bytes, map(np.asarray, b["x"]))))}
        own = [place.get(x, -1) for x in zip(a["id"].fillna(0), a["id"].isna(), map(bytes, map(np.asarray, a["x"])))]
        ids = [None if pd.isna(x) else int(x) for x in b["id"]]
        by_id = np.argsort(np.argsort([(1 << 63) if x is None else x for x in ids], kind="stable"), kind="stable")
        at_q, at_r, score, _ = search(q, np.array(own, int), r, by_id, b["many"].to_numpy(), k)
        own_ids = [None if pd.isna(x) else int(x) for x in a["id"]]
        out = pd.DataFrame({
            "asked": a["key"].to_numpy()[at_q], "query_id": [own_ids[i] for i in at_q], "repeats": a["many"].to_numpy()[at_q],
            "id": [ids[i] for i in at_r], "score": [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score],
            "many": [int(b["many"].iat[j]) - (own[i] == j) for i, j in zip(at_q, at_r)],
        })
        return out.astype({"query_id": "Int64", "id": "Int64"})

    near = (
        asked.groupBy("block", "ask_block")
        .cogroup(held.groupBy("block", "ask_block"))
        .applyInPandas(run, "asked long, query_id long, repeats long, id long, score long, many long")
    )
    # a row that occurs often fills k places at most, and equal queries have equal answers
    each = near.withColumn("copy", F.explode(F.expr(f"sequence(1, least(many, {k}L))")))
    best = Window.partitionBy("asked", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (
        each.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("again", F.explode(F.expr("sequence(1, repeats)")))
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
