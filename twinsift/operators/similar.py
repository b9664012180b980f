"""Near-identical images: candidates by Hamming distance or capture time, checks, clusters.

``hashes`` has (idx, variants, phash, dhash): ``idx`` numbers images in path order, hashes are
64-bit integers, ``variants`` holds eight (p, d) pairs of the turned and mirrored image.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from .base import checkpointed, components, ensure_checkpoints, numbered

#: Candidates are searched up to this distance at least, and to the largest threshold at most.
LEAST_BOUND, MOST_BOUND = 12, 16
WINDOW_S, NEIGHBOURS = 60, 6
THRESHOLDS = {"strict": 4, "normal": 8, "loose": 12}
#: Images of an indexed block, and of a chunk that is looked up in it; a chunk and a block are one task's.
BLOCK, CHUNK = 1 << 19, 1 << 14
#: Bits of a hash, of an index at most, and pairs that are looked at together, so that they stay in a core's cache.
BITS, MOST_WIDTH, AT_ONCE = 64, 16, 1 << 14
#: Nanoseconds that a look-up, each pair that it leads to and a pair without an index cost.
LOOK_UP, FOUND, PLAIN = 6, 3, 2
#: Shots of a stretch of the order by capture time, which is one task's.
STRETCH = 4096
#: Every so many rounds what is undecided is cut into components; those of so many links at most are decided in one go.
ROUNDS, SMALL = 3, 500_000


def parse_threshold(text: str) -> int:
    """A preset's name or a number from 0 to 16."""
    found = THRESHOLDS.get(text.strip().lower())
    if found is None:
        found = int(text)
    if not 0 <= found <= MOST_BOUND:
        raise ValueError(f"the threshold must be from 0 to {MOST_BOUND}")
    return found


def candidate_bound(threshold: int) -> int:
    return min(MOST_BOUND, max(threshold, LEAST_BOUND))


def usable(hashes: DataFrame) -> DataFrame:
    """Flat images, whose hashes say nothing, go."""
    return hashes.where(F.bit_count("phash").between(3, 61))


def image_files(files: DataFrame, codec: bool = False) -> DataFrame:
    return files.where((F.col("size") > 0) & paths.is_raster(F.col("path"), codec))


def collapse_exact(images: DataFrame, recommended: DataFrame) -> DataFrame:
    """(path, aliases): one image for each set of equal ones, the others as its aliases.

    ``images`` has one row per file identity, its smallest path, and ``links``; only groups
    of which at least two images are present collapse; the kept one stands for them.
    """
    known = images.join(recommended.select("path", "group_id", (F.col("verdict") == "keep").alias("kept")), "path", "left")
    several = known.where("group_id is not null").groupBy("group_id").agg(
        F.count("*").alias("n"), F.min_by("path", F.struct(~F.col("kept"), "path")).alias("stands")
    ).where("n > 1").select("group_id", "stands")
    merged = known.join(several, "group_id", "left").withColumn("stands", F.coalesce("stands", "path"))
    own = F.when(F.col("path") == F.col("stands"), F.array().cast("array<string>")).otherwise(F.array("path"))
    return merged.groupBy(F.col("stands").alias("path")).agg(
        F.array_sort(F.flatten(F.collect_list(F.concat(own, "links")))).alias("aliases")
    )


def hamming_candidates(hashes: DataFrame, bound: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(i, j, variant, dp, dd) of pairs i < j of which one variant is near in both hashes.

    Chunks of images meet blocks of them, each pair of these in one task, so that memory is bounded and no row is joined with
    another.  A task indexes its block by segments of the first hash: two hashes within the
    bound are, in one segment at least, within its share of it.  All keys so near are looked up, and
    what they lead to is compared whole, so that no pair is lost; how many segments there are goes by the block's size, and small
    blocks are compared without.  Of all eight variants the best is reported, by the
    larger of its two distances, then their sum, then its number; of images that share an index, the best pair.
    """
    hashes = checkpointed(hashes.select("idx", F.col("variants.p").alias("vp"), F.col("variants.d").alias("vd"), "phash", "dhash"))
    n = hashes.count()
    n_blocks, n_chunks = max(1, -(-n // block)), max(1, -(-n // min(block, chunk)), min(32, n // 512))

    def dealt(salt: int, parts: int) -> Column:
        return F.pmod(F.xxhash64("idx", "phash", F.lit(salt)), F.lit(parts)).cast("int")

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    asking = hashes.select("idx", "vp", "vd", dealt(1, n_chunks).alias("x"), each(n_blocks).alias("y"))
    asked = hashes.select("idx", "phash", "dhash", each(n_chunks).alias("x"), dealt(2, n_blocks).alias("y"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _near(a, b, bound)

    found = asking.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInPandas(near, "i long, j long, variant int, dp int, dd int")
    cost = F.struct(F.greatest("dp", "dd").alias("larger"), (F.col("dp") + F.col("dd")).alias("both"), "variant", "dp", "dd")
    return found.groupBy("i", "j").agg(F.min(cost).alias("b")).select("i", "j", "b.variant", "b.dp", "b.dd")


def _near(a: pd.DataFrame, b: pd.DataFrame, bound: int) -> pd.DataFrame:
    """Pairs with a's index below b's, a's variants held against b's plain hashes."""
    if a.empty or b.empty:
        return pd.DataFrame(columns=["i", "j", "variant", "dp", "dd"])
    ia, ib = a["idx"].to_numpy(), b["idx"].to_numpy()
    vp, vd = (np.stack(a[c].map(np.asarray).to_list()).astype(np.int64).view(np.uint64) for c in ("vp", "vd"))
    p, d = (b[c].to_numpy(np.int64).view(np.uint64) for c in ("phash", "dhash"))
    keys = [np.empty(0, np.int64)]
    plan = _segments(bound, len(ib))
    for q, c in _indexed(vp.ravel(), p, bound, plan) if plan else _plain(vp.ravel(), p, bound):
        r = q // vp.shape[1]
        good = (ia[r] < ib[c]) & (np.bitwise_count(vd.ravel()[q] ^ d[c]) <= bound)
        keys.append(r[good] * len(ib) + c[good])
    r, c = np.divmod(np.unique(np.concatenate(keys)), len(ib))
    found = []
    for first in range(0, max(1, len(r)), AT_ONCE):
        rr, cc = r[first : first + AT_ONCE], c[first : first + AT_ONCE]
        dp = np.bitwise_count(vp[rr] ^ p[cc, None]).astype(np.int32)
        dd = np.bitwise_count(vd[rr] ^ d[cc, None]).astype(np.int32)
        cost = (np.maximum(dp, dd) * 1000 + dp + dd) * 10 + np.arange(vp.shape[1])
        best, row = cost.argmin(1), np.arange(len(rr))
        found.append(pd.DataFrame({"i": ia[rr], "j": ib[cc], "variant": best, "dp": dp[row, best], "dd": dd[row, best]}))
    return pd.concat(found)


def _plain(asking: np.ndarray, asked: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in both) of hashes within the bound of each other, all compared."""
    step = max(1, AT_ONCE // len(asked))
    for first in range(0, len(asking), step):
        q, c = np.nonzero(np.bitwise_count(asking[first : first + step, None] ^ asked) <= bound)
        yield q + first, c


@lru_cache(64)
def _segments(bound: int, n: int) -> tuple[tuple[int, int, int], ...]:
    """(first bit, bits, distance) of the segments whose index of n hashes costs least; none if comparing all costs less.

    The distances, each plus one, add up to the bound plus one, so that not all of them can be exceeded.
    """
    least, best = PLAIN * n, ()
    for m in range(-(-BITS // MOST_WIDTH), 9):
        edges = [BITS * k // m for k in range(m + 1)]
        widths = [b - a for a, b in zip(edges, edges[1:])]
        share, rest = divmod(bound + 1, m)
        wide = sorted(range(m), key=lambda k: -widths[k])[:rest]
        reach = [share - 1 + (k in wide) for k in range(m)]
        keys = [sum(comb(w, x) for x in range(t + 1)) for w, t in zip(widths, reach)]
        cost = sum(k * (LOOK_UP + FOUND * _slots(n, w)) for k, w in zip(keys, widths))
        if cost < least:
            least, best = cost, tuple((e, w, t) for e, w, t in zip(edges, widths, reach) if t >= 0)
    return best


@lru_cache(16)
def _ball(width: int, reach: int) -> np.ndarray:
    """All numbers of so many bits with as few ones."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << width, dtype=np.uint32)) <= reach).astype(np.int32)


def _slots(n: int, width: int) -> int:
    """Hashes that are looked at together from where a key's begin, those of the next key among them."""
    return int(1.5 * n / 2**width) + 2


def _indexed(
    asking: np.ndarray, asked: np.ndarray, bound: int, plan: tuple[tuple[int, int, int], ...]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by an index of each segment, a pair possibly more than once.

    Both sides are sorted by the segment, so that look-ups stand close together.
    """
    for first, width, reach in plan:
        key = lambda x: (x >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int32)  # noqa: B023, E731
        ka, kb = key(asking), key(asked)
        by_a, by_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, a = ka[by_a], asking[by_a]
        size = np.bincount(kb, minlength=1 << width)
        start = np.cumsum(size) - size
        slots = _slots(len(kb), width)
        by_b = np.append(by_b, np.full(slots, by_b[-1]))
        b = asked[by_b]
        for begin in range(0, len(ka), AT_ONCE):
            part = ka[begin : begin + AT_ONCE]
            for mask in _ball(width, reach):
                at = part ^ mask
                held, place, own, q = size[at], start[at], a[begin : begin + AT_ONCE], None
                while len(place):
                    for slot in range(slots):
                        near = np.flatnonzero(np.bitwise_count(b[slot:].take(place) ^ own) <= bound)
                        if len(near):
                            yield by_a[begin + (near if q is None else q[near])], by_b[place[near] + slot]
                    more = np.flatnonzero(held > slots)
                    q = more if q is None else q[more]
                    held, place, own = held[more] - slots, place[more] + slots, own[more]


def best_variant(variants: Column, phash: Column, dhash: Column) -> Column:
    """The variant nearest to a plain pair of hashes, as (larger, both, variant, dp, dd)."""
    def cost(v: Column, k: Column) -> Column:
        dp, dd = F.bit_count(v["p"].bitwiseXOR(phash)), F.bit_count(v["d"].bitwiseXOR(dhash))
        return F.struct(F.greatest(dp, dd).alias("larger"), (dp + dd).alias("both"), k.alias("variant"), dp.alias("dp"), dd.alias("dd"))

    return F.array_min(F.transform(variants, cost))


def scene_candidates(
    shots: DataFrame, window_s: int = WINDOW_S, neighbours: int = NEIGHBOURS, stretch: int = STRETCH
) -> DataFrame:
    """(i, j, variant, dp, dd) of images taken shortly after one another.

    Each meets the next few by capture time, as long as these are in the window.  Shots are numbered in
    their order and cut into stretches of equal length by their numbers; each stretch also gets the first few
    shots of the next, so that a burst with one time is spread over all tasks.
    """
    known = numbered(shots.where("taken is not null").select("idx", "taken", "phash", "dhash"), [F.col("taken"), F.col("idx")], "place")
    own = known.withColumns({"stretch": F.expr(f"place div {stretch}"), "guest": F.lit(False)})
    early = own.where(F.col("stretch") > 0).where(F.pmod("place", F.lit(stretch)) < neighbours)
    # where stretches are shorter than the neighbourhood, a shot visits several of them
    visits = F.sequence(F.lit(1).cast("long"), F.least(F.col("stretch"), F.lit(-(-neighbours // stretch)).cast("long")))
    guests = early.select("*", F.explode(visits).alias("back")).withColumns({"stretch": F.col("stretch") - F.col("back"), "guest": F.lit(True)}).drop("back")
    rows = own.unionByName(guests)
    after = Window.partitionBy("stretch").orderBy("place").rowsBetween(1, neighbours)
    row = F.struct("idx", "taken", "phash", "dhash")
    # generators can't stand around windows in one projection
    following = rows.select("*", F.collect_list(row).over(after).alias("next")).where(~F.col("guest"))
    pairs = following.select("idx", "taken", "phash", "dhash", F.explode("next").alias("o")).where(F.col("o.taken") - F.col("taken") <= window_s)
    return pairs.select(
        F.least("idx", "o.idx").alias("i"), F.greatest("idx", "o.idx").alias("j"), F.lit(0).alias("variant"),
        F.bit_count(F.col("phash").bitwiseXOR(F.col("o.phash"))).alias("dp"),
        F.bit_count(F.col("dhash").bitwiseXOR(F.col("o.dhash"))).alias("dd"),
    )


def merge_candidates(by_hash: DataFrame, by_time: DataFrame) -> DataFrame:
    """Both sets by pair; what the hashes say wins, ``by_time`` tells that time found it too."""
    h, t = by_hash.alias("h"), by_time.alias("t")
    same = (F.col("h.i") == F.col("t.i")) & (F.col("h.j") == F.col("t.j"))
    return h.join(t, same, "full_outer").select(
        *[F.coalesce(f"h.{c}", f"t.{c}").alias(c) for c in ("i", "j", "variant", "dp", "dd")],
        F.col("t.i").isNotNull().alias("by_time"),
    )


def accepted_by_hash(candidates: DataFrame, threshold: int) -> DataFrame:
    """Candidates near enough in both hashes to need no look at their pixels."""
    return candidates.where((F.col("dp") <= threshold) & (F.col("dd") <= threshold)).select(
        "i", "j", "variant", F.col("dp").alias("distance"), (1 - F.col("dp") / 64).alias("similarity")
    )


def _in_order(links: pd.DataFrame) -> pd.DataFrame:
    """The leaders of a component, given all its links (own, other) in both directions."""
    links = links.sort_values("own")
    own, start = np.unique(links["own"].to_numpy(), return_index=True)
    other, stop = np.searchsorted(own, links["other"].to_numpy()), np.append(start[1:], len(links))
    led, leads = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for k in range(len(own)):
        if not led[k]:
            leads[k] = True
            led[other[start[k] : stop[k]]] = True
    return pd.DataFrame({"own": own[leads]})


def leader_clusters(ranked: DataFrame, edges: DataFrame, rounds: int = ROUNDS, small: int = SMALL) -> DataFrame:
    """(idx, leader): in order of rank each joins its best-ranked neighbouring leader.

    ``ranked`` has (idx, rank), ranks distinct; ``edges`` has (i, j).  Each round all that no better undecided
    neighbour precedes lead, and their neighbours are decided.  That settles most in a few rounds, but a
    chain of ever worse neighbours needs as many as it has links; so after every ``rounds`` what is left falls into connected
    components, of which those with up to ``small`` links are decided whole, in order, each in one task; larger ones
    go on in rounds and fall apart.  A round reads the links between undecided images only, and
    what it leaves of these and of the images is written to the checkpoint folder.
    """
    ensure_checkpoints(ranked.sparkSession)
    edges = edges.select("i", "j").checkpoint()
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    rank_of = ranked.select(F.col("idx").alias("j"), F.col("rank").alias("other"))
    links = both.join(ranked.select(F.col("idx").alias("i"), F.col("rank").alias("own")), "i").join(rank_of, "j").select("own", "other")
    links = links.checkpoint()
    live, open_links = ranked.select(F.col("rank").alias("own")), links
    lead: list[DataFrame] = []
    for number in count(1):
        # who has a better undecided neighbour waits
        state = live.join(
            open_links.where("other < own").select("own").distinct().withColumn("blocked", F.lit(True)), "own", "left"
        ).checkpoint()
        fresh = state.where("blocked is null").select("own")
        lead.append(fresh)
        waiting = state.where("blocked").select("own")
        if waiting.isEmpty():
            break
        reached = open_links.join(fresh.select(F.col("own").alias("other")), "other", "left_semi").select("own").distinct()
        live = waiting.join(reached, "own", "left_anti").checkpoint()
        if live.isEmpty():
            break
        open_links = (
            open_links.join(live, "own", "left_semi")
            .join(live.select(F.col("own").alias("other")), "other", "left_semi").checkpoint()
        )
        if number % rounds == 0:
            parts = components(open_links.select(F.col("own").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "own")
            placed = open_links.join(parts, "own")
            whole = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= small).select("root")
            lead.append(placed.join(whole, "root", "left_semi").groupBy("root").applyInPandas(lambda x: _in_order(x), f"own {dict(ranked.dtypes)['rank']}").checkpoint())
            decided = parts.join(whole, "root", "left_semi").select("own")
            live = live.join(decided, "own", "left_anti").checkpoint()
            if live.isEmpty():
                break
            open_links = open_links.join(decided, "own", "left_anti").checkpoint()
    leaders = reduce(DataFrame.unionByName, lead).select(F.col("own").alias("other")).checkpoint()
    best = links.join(leaders, "other", "left_semi").groupBy("own").agg(F.min("other").alias("best"))
    leads = leaders.select(F.col("other").alias("own"), F.lit(True).alias("leads"))
    everyone = ranked.select(F.col("rank").alias("own")).join(leads, "own", "left").join(best, "own", "left")
    chosen = everyone.select("own", F.when(F.col("leads"), F.col("own")).otherwise(F.col("best")).alias("led"))
    ids = ranked.select("idx", F.col("rank").alias("own"))
    names = ranked.select(F.col("idx").alias("leader"), F.col("rank").alias("led"))
    return chosen.join(ids, "own").join(names, "led").select("idx", "leader")
