"""SimHash near-duplicates by multi-index hashing.

A text's 3-word shingles are hashed by XXH64 (seed 42); a bit of its fingerprint is set if
more than half of the hashes have it.  Fingerprints link at two differing bits or fewer.

Equal fingerprints collapse to one before anything is joined, so that thousands of copies
cost one row.  A fingerprint is cut into two halves.  If two differ in two bits at most,
their first halves differ in one bit at most, or their second halves are equal: each asks
the table of first halves for its own and for those one bit away (only for bits that it
has unset, as the other one asks the opposite way), and the table of second halves for its
own.  What is fetched is verified by its complete distance.  A half that would give more than
``most_pairs`` pairs isn't joined: its fingerprints and those that ask for it all meet in
an exact other way, the fingerprints one bit away from each (two fingerprints share one of these, or
each other, if and only if they differ in two bits at most), linked as stars.

``representatives`` removes near copies: texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more.  It fetches by SimHash and decides by the sets.  Five words spread so far by one edit
that no small ball would hold a copy's fingerprint, so the fetch takes those of the texts' distinct words, within
``NEAR`` bits: these are cut into segments, few long ones for many texts and more short ones for few, with balls so large that
by the pigeonhole principle no pair is missed; what is fetched is verified by its complete distance, by the
sizes of both sets, then by the sets themselves.  Where a key of a segment's table would give more than
``most_pairs`` times as many pairs as it has rows, its texts meet in blocks: first each gives the smallest that it may
link to, which are verified as the others are; texts of different components that may still link then meet again
in blocks with their sets.  Sets are large, so that they only go to pairs that short sketches leave: these rule out no pair
that links.  So no link is lost behind a crowded key, and nothing written grows with the square of a group.

Null and wordless texts have fingerprint zero and link like any other; rows with a null id
belong to the component but never name it; a component without any id is named null.
Repeated rows stay as they are.  An empty table gives an empty result.  Very long texts are hashed
whole, in blocks.  ``near_duplicates`` leaves other columns out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed

SEED, SHINGLE, HALF = 42, 3, 32
#: Near copies: words of a shingle, and the least similarity as a fraction.
LONG_SHINGLE, COMMON, OF = 5, 4, 5
#: How many bits of the distinct words' fingerprints may differ.
NEAR = 7
#: Fingerprints of a block, and shingles of a block of sets; two blocks are compared in one task.
BLOCK, SET_BLOCK = 8_192, 1 << 22
#: So many crowded keys, of 12 bytes each, are small enough to send to every executor.
FEW_KEYS = 1 << 20
#: So many rows of a few numbers, too; and rows for which a task is worth starting.
FEW_ROWS, TASK_ROWS = 1 << 17, 1 << 16
#: Numbers of 64 bits in a set's sketch.
MARKS = ("m0", "m1", "m2", "m3")


def _word_blocks(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text, cut at white space into lists of about ``size`` bytes."""
    at = 0
    while at < len(raw):
        stop = min(at + size, len(raw))
        while stop < len(raw) and not raw[stop : stop + 1].isspace():
            stop += 1
        yield raw[at:stop].split()
        at = stop


def _hashes(text: str | None, shingle: int, block: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, or of the whole sequence if it is shorter; works through long texts in blocks."""
    carried: list[bytes] = []
    none = True
    for found in _word_blocks((text or "").encode().lower(), block):
        found = carried + found
        carried = found[max(0, len(found) - shingle + 1) :]
        if len(found) < shingle:
            continue
        joined = b" ".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(found) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        slices = [joined[a:b] for a, b in zip(starts, stops)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), "<u8", len(slices))
        none = False
    if none and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], "<u8")


def _majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that more than half of the hashes have."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        for first in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[first : first + (1 << 14)].view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, 64).sum(0, dtype=np.uint32)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 8 << 20) -> int:
    """64 bits, the majority of the shingles' hashes; works through long texts in blocks."""
    return _majority(_hashes(text, shingle, block))


def shingle_set(text: str | None, block: int = 8 << 20) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, ascending."""
    known = np.zeros(0, "<u8")
    for hashes in _hashes(text, LONG_SHINGLE, block):
        known = np.union1d(known, hashes)
    return known


def word_print(text: str | None, block: int = 8 << 20) -> int:
    """64 bits, the majority of the distinct words' hashes."""
    words: set[bytes] = set()
    for found in _word_blocks((text or "").encode().lower(), block):
        words.update(found)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), "<u8", len(words))
    return _majority(iter([hashes]))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    fields = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, fields)


def _bits(n: int) -> Column:
    return F.array(*[F.lit(np.int64(1 << k if k < 63 else -(1 << 63)).item()) for k in range(n)])


def links(distinct: DataFrame, most_pairs: int = 1 << 16) -> DataFrame:
    """(a, b) with a link in both directions, enough to connect all that links connect.

    ``distinct`` has one column, ``fp``, best checkpointed: it is read several times.
    """
    low = F.col("fp").bitwiseAND((1 << HALF) - 1)
    high = F.shiftright("fp", HALF).bitwiseAND((1 << HALF) - 1)
    flips = F.filter(_bits(HALF), lambda x: low.bitwiseAND(x) == 0)
    ball = F.concat(F.array(low), F.transform(flips, lambda x: low.bitwiseOR(x)))

    def slot(half: int, key: Column) -> Column:
        return F.struct(F.lit(half).alias("half"), key.alias("key"))

    held = distinct.select("fp", F.explode(F.array(slot(0, low), slot(1, high))).alias("k"))
    asks_for = F.concat(F.transform(ball, lambda x: slot(0, x)), F.array(slot(1, high)))
    asked = distinct.select("fp", F.explode(asks_for).alias("k"))
    held = held.select("k.half", "k.key", F.col("fp").alias("b"))
    asked = asked.select("k.half", "k.key", F.col("fp").alias("a"))
    # a key that one fingerprint holds gives no more pairs than ask for it
    crowded = held.groupBy("half", "key").agg(F.count("*").alias("n_held")).where("n_held > 1")
    hot = checkpointed(
        asked.join(crowded, ["half", "key"])
        .groupBy("half", "key", "n_held").agg(F.count("*").alias("n_asked"))
        .where(F.col("n_held") * F.col("n_asked") > most_pairs)
        .select("half", "key")
    )
    pairs = (
        asked.join(hot, ["half", "key"], "left_anti")
        .join(held, ["half", "key"])
        .where("a <> b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    crowd = (
        asked.join(hot, ["half", "key"], "left_semi").select(F.col("a").alias("fp"))
        .unionByName(held.join(hot, ["half", "key"], "left_semi").select(F.col("b").alias("fp")))
        .distinct()
    )
    near = crowd.select("fp", F.explode(F.concat(
        F.array(F.col("fp")), F.transform(_bits(64), lambda x: F.col("fp").bitwiseXOR(x))
    )).alias("point"))
    star = near.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(star, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    found = pairs.unionByName(stars)
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return found.select(F.explode(turned).alias("link")).select("link.a", "link.b").distinct()


def _sent(rows: DataFrame, n: int, few: int = FEW_ROWS) -> DataFrame:
    """``n`` rows for a join, sent to every executor if they are few."""
    return F.broadcast(rows) if n <= few else rows


def _gathered(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, if they are few in no more tasks than they are worth."""
    return rows.coalesce(max(1, -(-n // TASK_ROWS))) if n <= FEW_ROWS else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the symmetric ``edges`` reaches.

    Every round each node takes the smallest label among its neighbours, then its label's
    label, so that the rounds grow with the logarithm of the longest path.  Of a few edges the labels are sent
    to all tasks, of which there are as many as the edges are worth.
    """
    edges = checkpointed(edges)
    n = edges.count()
    edges = _gathered(edges, n)
    labels = checkpointed(_gathered(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        .select("node", F.least("node", "root").alias("root")), n
    ))
    while True:
        heard = (
            edges.join(_sent(labels, n), edges["b"] == labels["node"])
            .groupBy("a").agg(F.min("root").alias("heard"))
        )
        lowered = heard.join(_sent(labels, n), labels["node"] == heard["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "heard").alias("root")
        )
        onward = labels.select(F.col("node").alias("at"), F.col("root").alias("onward"))
        moved = checkpointed(_gathered(
            lowered.join(_sent(onward, n), F.col("root") == F.col("at"))
            .select("node", "old", F.least("root", "onward").alias("root")), n
        ))
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``df``.

    ``component_id`` is the smallest id reachable.
    """
    found = checkpointed(fingerprints(df, id_col, text_col))
    distinct = checkpointed(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct.select("fp")))
    named = (
        distinct.join(roots, distinct["fp"] == roots["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(names, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(classes, F.col("fp") == F.col("of")).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def segments(n: int, near: int = NEAR) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment of the first 64 bits, for ``n`` fingerprints.

    If two fingerprints differ in ``near`` bits at most, at least one of their segments differs
    in its radius at most: the radii and one for each add up to one more than ``near``.
    """
    many = 4 if n < 1 << 22 else 3 if n < 1 << 30 else 2
    widths = [64 // many + (k < 64 % many) for k in range(many)]
    return [
        (sum(widths[:k]), width, (near + 1) // many + (k < (near + 1) % many) - 1) for k, width in enumerate(widths)
    ]


def crowded(n: int, cuts: list[tuple[int, int, int]]) -> float:
    """From how many pairs a row on a key of ``n`` texts is crowded: a dozen times its share of them, eight at least.

    So a key counts as crowded because of its group, however many texts there are.
    """
    return max(8.0, 12 * n / (1 << min(width for _, width, _ in cuts)))


def shapes(keyed: DataFrame) -> DataFrame:
    """(of, key, s0, s1, size, fp) of (of, text, key): 128 bits of the set of shingles, its size, the words' fingerprint."""
    fields = ", ".join(f"{x} {keyed.schema[x].dataType.simpleString()}" for x in ("of", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                known = shingle_set(text)
                digest = xxhash.xxh3_128_digest(known.tobytes())
                rows.append((*np.frombuffer(digest, "<i8").tolist(), len(known), int(np.uint64(word_print(text)).view(np.int64))))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["of", "key", "s0", "s1", "size", "fp"])

    return keyed.select("of", "text", "key").mapInArrow(run, f"{fields}, s0 long, s1 long, size long, fp long")


def sketch(known: np.ndarray) -> np.ndarray:
    """256 bits of a set of hashes: whether an odd number of them falls on each.

    Two sketches differ in no more bits than there are hashes that only one of the sets has.
    """
    odd = np.bincount((known & np.uint64(64 * len(MARKS) - 1)).astype(np.int64), minlength=64 * len(MARKS)) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def sets(texts: DataFrame) -> DataFrame:
    """(node, known, m0 to m3) of (node, text): the set of shingles and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [shingle_set(x) for x in batch.column(1).to_pylist()]
            marks = np.array([sketch(x) for x in found], np.int64).reshape(-1, len(MARKS))
            columns = [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(marks.T))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "known", *MARKS])

    return texts.select("node", "text").mapInArrow(run, f"node long, known array<long>, {', '.join(f'{x} long' for x in MARKS)}")


def _alike(pairs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Pairs whose sets may have enough in common by their sketches and sizes: all that link, and few that don't.

    If ``COMMON`` in ``OF`` of all are common, so many of one set aren't in the other: (OF - COMMON) / (OF + COMMON) of both sizes' sum.
    """
    side = lambda x: _sent(known.select(F.col("node").alias(x), F.size("known").alias(f"size_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in MARKS]), n)
    apart = " + ".join(f"bit_count({m}_a ^ {m}_b)" for m in MARKS)
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(f"{OF + COMMON} * ({apart}) <= {OF - COMMON} * (size_a + size_b)").select("a", "b")
    )


def _slots(nodes: DataFrame, cuts: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """(key, node, fp, size), as held in the segments' tables and as asked for; a key names its segment too."""
    held, asked = [], []
    for number, (shift, width, radius) in enumerate(cuts):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
        flips = [sum(1 << i for i in at) for r in range(1, radius + 1) for at in combinations(range(width), r)]
        # of two that differ the one asks that has the lowest differing bit unset
        asks = F.filter(F.array(*map(F.lit, flips or [0])), lambda x: key.bitwiseAND(x.bitwiseAND(-x)) == 0)  # noqa: B023
        ball = F.concat(F.array(key), F.transform(asks, key.bitwiseXOR)) if flips else F.array(key)
        named = lambda x: x.cast("long") * len(cuts) + number  # noqa: B023, E731
        held.append(named(key))
        asked.append(F.transform(ball, named))
    rest = ("node", "fp", "size")
    return (
        nodes.select(F.explode(F.array(*held)).alias("key"), *rest),
        nodes.select(F.explode(F.flatten(F.array(*asked))).alias("key"), *rest),
    )


def _dealt(asked: DataFrame, held: DataFrame, weights: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Both with blocks (x, y), so that each block of those who ask meets each block of those held in one group.

    ``weights`` has (key, n_asked, n_held); a block weighs about ``limit``.
    """
    n_blocks = lambda x: F.ceil(F.col(x) / limit)
    own = lambda x: F.pmod(F.xxhash64("node"), n_blocks(x))
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), n_blocks(x) - 1))
    return (
        asked.join(weights, "key").select(*asked.columns, own("n_asked").alias("x"), every("n_held").alias("y")),
        # new names for the same columns, as both sides may come from the same rows
        held.join(weights, "key").select(*[F.col(x).alias(x) for x in held.columns], every("n_asked").alias("x"), own("n_held").alias("y")),
    )


def _near(a: pd.DataFrame, b: pd.DataFrame, near: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of ``a`` from which on, and which of them may link to which of ``b``, by fingerprints and sizes."""
    fp_a, fp_b = a["fp"].to_numpy(np.int64).view(np.uint64), b["fp"].to_numpy(np.int64).view(np.uint64)
    n_a, n_b = a["size"].to_numpy(np.int64), b["size"].to_numpy(np.int64)
    node_a, node_b = a["node"].to_numpy(np.int64), b["node"].to_numpy(np.int64)
    for first in range(0, len(a), 256):
        at = slice(first, first + 256)
        may = np.bitwise_count(fp_a[at, None] ^ fp_b[None]) <= near
        may &= (OF * n_a[at, None] >= COMMON * n_b[None]) & (OF * n_b[None] >= COMMON * n_a[at, None])
        yield first, may & (node_a[at, None] != node_b[None])


def _smallest(a: pd.DataFrame, b: pd.DataFrame, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of both the smallest node of the other that it may link to; the largest integer where none is."""
    none = np.iinfo(np.int64).max
    node_a, node_b = a["node"].to_numpy(np.int64), b["node"].to_numpy(np.int64)
    of_a, of_b = np.full(len(a), none), np.full(len(b), none)
    for first, may in _near(a, b, near):
        of_a[first : first + len(may)] = np.where(may, node_b[None], none).min(1, initial=none)
        of_b = np.minimum(of_b, np.where(may, node_a[first : first + len(may), None], none).min(0, initial=none))
    return of_a, of_b


def _first_pairs(a: pd.DataFrame, b: pd.DataFrame, near: int) -> pd.DataFrame:
    of_a, of_b = _smallest(a, b, near)
    found = pd.DataFrame({"a": np.concatenate([a["node"], b["node"]]), "b": np.concatenate([of_a, of_b])}, dtype=np.int64)
    found = found[found["b"] != np.iinfo(np.int64).max]
    return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)}, dtype=np.int64).drop_duplicates()


def _undecided(a: pd.DataFrame, b: pd.DataFrame, near: int) -> pd.DataFrame:
    """Rows of both that may link to one of another component, by their sketches too, and weren't each other's smallest."""
    of_a, of_b = _smallest(a, b, near)
    root_a, root_b = a["root"].to_numpy(np.int64), b["root"].to_numpy(np.int64)
    node_a, node_b = a["node"].to_numpy(np.int64), b["node"].to_numpy(np.int64)
    marks_a, marks_b = (x[list(MARKS)].to_numpy(np.int64).view(np.uint64) for x in (a, b))
    n_a, n_b = a["size"].to_numpy(np.int64), b["size"].to_numpy(np.int64)
    some_a, some_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for first, may in _near(a, b, near):
        at = slice(first, first + len(may))
        may &= root_a[at, None] != root_b[None]
        may &= (of_a[at, None] != node_b[None]) & (of_b[None] != node_a[at, None])
        i, j = np.nonzero(may)
        apart = np.bitwise_count(marks_a[first + i] ^ marks_b[j]).sum(1, dtype=np.int64)
        may[i, j] = (OF + COMMON) * apart <= (OF - COMMON) * (n_a[first + i] + n_b[j])
        some_a[at], some_b = may.any(1), some_b | may.any(0)
    key = a["key"].iloc[0] if len(a) else b["key"].iloc[0] if len(b) else 0
    nodes = np.concatenate([node_a[some_a], node_b[some_b]])
    return pd.DataFrame({"key": np.full(len(nodes), key), "node": nodes, "asks": np.arange(len(nodes)) < some_a.sum()})


def _by_sets(a: pd.DataFrame, b: pd.DataFrame, near: int) -> pd.DataFrame:
    """Links between the two, enough to connect all that links connect."""
    linked = []
    if len(a) and len(b):
        values, places = np.unique(np.concatenate(list(b["known"])), return_inverse=True)
        ends = np.cumsum([len(x) for x in b["known"]])
        parts = np.split(places, ends[:-1])
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        node_a, node_b, n_b = a["node"].tolist(), b["node"].tolist(), b["size"].tolist()
        root_a, root_b, n_a, known_a = a["root"].tolist(), b["root"].tolist(), a["size"].tolist(), a["known"].tolist()
        for first, may in _near(a, b, near):
            for row in np.flatnonzero(may.any(1)).tolist():
                i = first + row
                has = np.zeros(len(values), bool)
                at = np.searchsorted(values, known_a[i])
                at[at == len(values)] = 0
                has[at[values[at] == known_a[i]]] = True
                for j in np.flatnonzero(may[row]).tolist():
                    p, q = root(root_a[i]), root(root_b[j])
                    if p != q:
                        both = int(np.count_nonzero(has[parts[j]]))
                        if OF * both >= COMMON * (n_a[i] + n_b[j] - both):
                            up[max(p, q)] = min(p, q)
                            linked.append((node_a[i], node_b[j]))
    return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)


def _turned(pairs: DataFrame) -> DataFrame:
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(turned).alias("link")).select("link.a", "link.b").distinct()


def near_copies(nodes: DataFrame, texts: DataFrame, cuts: list[tuple[int, int, int]], near: int = NEAR, most_pairs: float = 8) -> DataFrame:
    """(node, root) of all nodes that link to others: the smallest node that each reaches.

    ``nodes`` has (node, fp, size, key), best checkpointed; ``texts`` has (key, text), where repeated rows do no harm.
    """
    held, asked = _slots(nodes, cuts)
    count = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias(name))
    weights = count(held, "n_held").join(count(asked, "n_asked"), "key")
    hot = checkpointed(weights.where(
        F.col("n_held") * F.col("n_asked") > most_pairs * (F.col("n_held") + F.col("n_asked"))
    ))
    n_hot = hot.count()
    hot_keys = _sent(hot.select("key"), n_hot, FEW_KEYS)
    one, two = asked.join(hot_keys, "key", "left_anti").alias("a"), held.join(hot_keys, "key", "left_anti").alias("b")
    fits = F.expr(f"{OF} * a.size >= {COMMON} * b.size and {OF} * b.size >= {COMMON} * a.size and bit_count(a.fp ^ b.fp) <= {near}")
    pairs = (
        one.join(two, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & fits)
        .select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    )
    block = ("key", "x", "y")
    met = lambda a, b: a.groupBy(*block).cogroup(b.groupBy(*block))
    first = met(*_dealt(asked, held, _sent(hot, n_hot), BLOCK)).applyInPandas(lambda a, b: _first_pairs(a, b, near), "a long, b long")
    fetched = checkpointed(pairs.unionByName(first).distinct())
    needed = checkpointed(fetched.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node"))
    n = needed.count()
    known = checkpointed(sets(texts.join(_sent(needed, n), "key").dropDuplicates(["node"])))
    left, right = (known.select(F.col("node").alias(x), F.col("known").alias(f"known_{x}")) for x in "ab")
    both = F.size(F.array_intersect("known_a", "known_b"))
    linked = (
        _alike(fetched, known, n).join(left, "a").join(right, "b")
        .where(OF * both >= COMMON * (F.size("known_a") + F.size("known_b") - both)).select("a", "b")
    )
    roots = components(_turned(linked))
    if hot.isEmpty():
        return roots
    labelled = checkpointed(_gathered(
        nodes.join(_sent(known.select("node", *MARKS), n), "node").join(_sent(roots, n), "node", "left")
        .select("node", "fp", "size", F.coalesce("root", "node").alias("root"), *MARKS), n
    ))
    rooted = lambda rows: rows.join(hot_keys, "key", "left_semi").join(_sent(labelled.select("node", "root", *MARKS), n), "node")
    again = checkpointed(
        met(*_dealt(rooted(asked), rooted(held), hot, BLOCK))
        .applyInPandas(lambda a, b: _undecided(a, b, near), "key long, node long, asks boolean").distinct()
    )
    if again.isEmpty():
        return roots
    again = again.join(_sent(labelled.drop(*MARKS), n), "node")
    weights = again.groupBy("key").agg(
        F.sum(F.when(F.col("asks"), F.col("size"))).alias("n_asked"), F.sum(F.when(~F.col("asks"), F.col("size"))).alias("n_held")
    )
    again = again.join(known.select("node", "known"), "node")
    rest = met(*_dealt(again.where("asks"), again.where("not asks"), weights, SET_BLOCK)).applyInPandas(
        lambda a, b: _by_sets(a, b, near), "a long, b long"
    )
    rest = checkpointed(rest)
    if rest.isEmpty():
        return roots
    return components(_turned(rest.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all columns: the smallest id, null last, then the smallest hash.

    Rows are told apart by 128 bits over all their columns, not by their ids.
    """
    rows = [F.col(f"`{x}`") for x in df.columns]
    rows += [x.isNull() for x in rows]  # a null leaves a hash as it is
    key = F.struct(F.xxhash64(*rows).alias("a"), F.xxhash64(F.lit(1), *rows).alias("b"))
    keyed = df.select(F.col(f"`{id_col}`").alias("of"), F.col(f"`{text_col}`").alias("text"), key.alias("key"))
    found = checkpointed(shapes(keyed))
    # equal rows have equal sets, so that their component is the same
    rank = F.struct(F.col("of").isNull().alias("unnamed"), "of", "key")
    by_rank = found.groupBy("s0", "s1", rank.alias("rank")).agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    by_set = by_rank.groupBy("s0", "s1").agg(F.min(F.struct("rank", "n", "size", "fp")).alias("least"))
    nodes = checkpointed(by_set.select("least", F.monotonically_increasing_id().alias("node")))
    narrow = nodes.select("node", "least.fp", "least.size", F.col("least.rank.key").alias("key"))
    n = nodes.count()
    cuts = segments(n)
    roots = near_copies(narrow, keyed.select("key", "text"), cuts, most_pairs=crowded(n, cuts))
    chosen = checkpointed(
        nodes.join(_sent(roots, roots.count()), "node", "left")
        .groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("least").alias("least"))
        .select(F.col("least.rank.key").alias("stays"), F.col("least.n").alias("n"))
    )

    n = chosen.count()

    def held(of: DataFrame) -> DataFrame:
        return df.join(_sent(of.select("stays"), n), key == F.col("stays"), "left_semi")

    if chosen.where("n > 1").isEmpty():
        return held(chosen)
    return held(chosen.where("n = 1")).unionByName(held(chosen.where("n > 1")).dropDuplicates())
