"""Merkle manifest of a dataset: leaves, subroots by language, a root, and proofs that are checked.

Leaves are hashed by Spark where texts are read; from there on rows are narrow.  They are put in
order by ranges of (language, id, leaf), so that each knows its place among its language's from
its place in its range.  Aligned buckets of ``2**LEVELS`` neighbours go to executors, where DuckDB works through
the levels of a bucket: ordered ``string_agg`` and ``sha256``.  A bucket's root is a node of the next round's buckets,
until one node is left of each language; these subroots are the leaves of one more tree.  Then proofs go
down again: a bucket's own siblings are followed by those of its root, joined from the round above.  No
task holds more than a bucket and no round depends on how the rows are spread over languages.

Nulls of any column are hashed as ``-``; a null language is the first.  Rows with a null id come first and
stand in the order of their leaves, as rows with one id do; they aren't tampered with.  Equal rows have equal
leaves and differ only by their places, and so in their proofs.  An empty table gives an empty result.  Long texts are hashed
whole.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a bucket: it holds two to this power of nodes.
LEVELS = 12
#: Rows of which this number divides the checksum are tampered with.
TAMPERED = 7
#: The worker's engine, one for all its buckets.
_engine: duckdb.DuckDBPyConnection | None = None


def _db() -> duckdb.DuckDBPyConnection:
    global _engine
    if _engine is None:
        _engine = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    return _engine


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(values[x]) for x in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """(doc_id, g, node, tampered): ``g`` orders languages, null first; ``tampered`` is the changed leaf, if it is one."""
    own = {x: F.col(f"`{x}`") for x in FIELDS}
    changed = F.crc32(own["doc_id"].cast("string").cast("binary")) % tampered == 0
    return docs.select(
        own["doc_id"].alias("doc_id"), F.coalesce(F.concat(F.lit("="), own["lang"]), F.lit("")).alias("g"), leaf(own).alias("node"),
        F.when(changed, leaf(own | {"n_chars": own["n_chars"] + 1})).alias("tampered"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``, from 0 within ``g``, and ``n``, the rows of ``g``; written to the shared folder.

    Equal rows are told apart by where they are read, so that no range is crowded.
    """
    by = ["g", *order, "tie"]
    dealt = checkpointed(rows).withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*[F.asc_nulls_first(x) for x in by]).sortWithinPartitions(*[F.asc_nulls_first(x) for x in by])
    at = F.monotonically_increasing_id()
    held = checkpointed(dealt.drop("tie").withColumn("at", at)).withColumn("part", F.shiftright("at", 33))
    spans = held.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("g")
    spans = spans.select(
        "g", "part", (F.sum("rows").over(own.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(own).alias("n"),
    )
    return held.join(spans, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _depth(n: int, levels: int) -> int:
    """Levels that a bucket of a tree of ``n`` nodes has: all, or as many as leave one node."""
    return levels if n > 1 << levels else (n - 1).bit_length()


def _climb(db: duckdb.DuckDBPyConnection, nodes: pa.Table, depth: int) -> None:
    """Tables n0 to n<depth>: the bucket's nodes level by level."""
    db.register("nodes", nodes)
    db.execute("create or replace temp table n0 as select pos, node from nodes")
    for k in range(depth):
        db.execute(
            f"create or replace temp table n{k + 1} as "
            f"select pos // 2 as pos, sha256(string_agg(node, '' order by pos)) as node from n{k} group by pos // 2"
        )


def raised(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, pos, n, node): each bucket's root, numbered as its bucket is."""
    def climb(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        depth, db = _depth(n, levels), _db()
        _climb(db, rows, depth)
        ((node,),) = db.execute(f"select node from n{depth}").fetchall()
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n >> levels)], "node": [node]})

    narrow = nodes.select("g", "pos", "n", "node", F.shiftright("pos", levels).alias("bucket"))
    return narrow.groupBy("g", "bucket").applyInArrow(climb, "g string, pos long, n long, node string")


def _siblings(depth: int) -> str:
    """Each node with s0 to s<depth - 1>, what stands beside it and beside those above it."""
    joins = [f"left join n{k} as b{k} on b{k}.pos = xor(c.pos >> {k}, 1)" for k in range(depth)]
    return f"select c.*{''.join(f', b{k}.node as s{k}' for k in range(depth))} from nodes as c {' '.join(joins)}"


def lowered(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, pos, path, subroot, root): the steps from each node to the root.

    A step is the sibling behind ``L`` or ``R``, for the side where it stands, or empty where there is none.
    ``above`` has the same of the buckets.
    """
    def go(key: tuple, rows: pa.Table, parent: pa.Table) -> pa.Table:
        depth, db = _depth(rows["n"][0].as_py(), levels), _db()
        _climb(db, rows.select(["pos", "n", "node"]), depth)
        steps = [f"case when s{k} is null then '' when pos >> {k} & 1 = 1 then 'L' || s{k} else 'R' || s{k} end" for k in range(depth)]
        top = parent.to_pylist()[0]
        query = f"select pos, [{', '.join(steps)}]::varchar[] || $above::varchar[] as path from ({_siblings(depth)})"
        found = db.sql(query, params={"above": top["path"]}).to_arrow_table()
        same = {x: pa.array([v] * len(found), pa.string()) for x, v in (("g", key[0].as_py()), ("subroot", top["subroot"]), ("root", top["root"]))}
        return pa.table({"g": same["g"], "pos": found["pos"].cast(pa.int64()), "path": found["path"].combine_chunks(), "subroot": same["subroot"], "root": same["root"]})

    schema = "g string, pos long, path array<string>, subroot string, root string"
    return _met(nodes.select("g", "pos", "n", "node"), above, levels).applyInArrow(go, schema)


def _met(nodes: DataFrame, above: DataFrame, levels: int):
    # new names: both sides may come from one table
    own = nodes.select(*[F.col(x).alias(x) for x in nodes.columns], F.shiftright("pos", levels).alias("bucket"))
    high = above.select(F.col("g").alias("g"), F.col("pos").alias("bucket"), *[F.col(x).alias(x) for x in ("path", "subroot", "root")])
    return own.groupBy("g", "bucket").cogroup(high.groupBy("g", "bucket"))


def checked(leaves: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf."""
    def go(rows: pa.Table, parent: pa.Table) -> pa.Table:
        depth, db = _depth(rows["n"][0].as_py(), levels), _db()
        _climb(db, rows.select(["pos", "node", "doc_id", "tampered"]), depth)
        top = parent.to_pylist()[0]
        own = "".join(f" || coalesce(s{k}, '')" for k in range(depth))
        query = f"select *, sha256(''{own} || $outer) as proof, coalesce(tampered, node) as f from ({_siblings(depth)})"
        for k in range(depth):
            run = f"case when s{k} is null then f when pos >> {k} & 1 = 1 then s{k} || f else f || s{k} end"
            query = f"select * replace (sha256({run}) as f) from ({query})"
        for step in top["path"]:
            side, beside = step[:1], step[1:]
            run = {"L": f"'{beside}' || f", "R": f"f || '{beside}'", "": "f"}[side]
            query = f"select * replace (sha256({run}) as f) from ({query})"
        query = (
            f"select doc_id, node as leaf, $subroot as subroot, $root as root, proof as proof_sha256, f as folded_root, "
            f"f = $root as verified from ({query})"
        )
        given = {"outer": "".join(x[1:] for x in top["path"]), "subroot": top["subroot"], "root": top["root"]}
        return db.sql(query, params=given).to_arrow_table()

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _met(leaves.select("g", "pos", "n", "node", "doc_id", "tampered"), above, levels).applyInArrow(go, schema)


def _tree(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each round, up to the one that leaves a node of each group; rounds grow with the logarithm of the rows."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(checkpointed(raised(rounds[-1], levels)))
    return rounds


def manifest(docs: DataFrame, levels: int = LEVELS, tampered: int = TAMPERED) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of ``docs``.

    ``folded_root`` follows from the tampered leaf, if there is one, and from the proof of the original.
    """
    trees = _tree(placed(leaves(docs, tampered), "doc_id", "node"), levels)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("lang"), "node")
    outer = _tree(placed(tops, "lang"), levels)
    names = outer[0].select("pos", "lang", "node")
    none = F.array().cast("array<string>")
    paths = outer[-1].select("g", "pos", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(outer[:-1]):
        paths = checkpointed(lowered(nodes, paths, levels))
    paths = paths.select("pos", "path", "root").join(names, "pos").select(
        F.col("lang").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"
    )
    for nodes in reversed(trees[1:-1]):
        paths = checkpointed(lowered(nodes, paths, levels))
    return checked(trees[0], paths, levels)
