"""Quality rules with risk-controlled cutoffs.

Words, symbols, repeated lines and repeated 3-word windows of each text give features; a
rule rejects what reaches a cutoff of one feature.  Labelled texts are dealt in two by a hash.
On the smaller part (``TUNING`` of them) all cutoffs of all rules are put in one order, the mildest
first, without those that reject poor texts hardly more often than good ones.  On the rest, the
holdout, each stratum goes through this fixed order: a cutoff is accepted as long as an exact
binomial (Clopper-Pearson) upper bound on the share of good texts that any rule so far
rejects stays under ``risk``, and the first that fails ends the stratum's tests.  A fixed
sequence needs no correction for its length, and the confidence is divided by the number of
strata (Bonferroni): with probability ``confidence`` no stratum loses more than ``risk`` of its good
texts to all rules together.  A stratum with too few labels (under some 220 good texts in the
holdout, by the defaults and four strata) gets no cutoffs and rejects nothing beyond the base rules.

Equal texts of a stratum count once in holdouts, as the bound asks for independent draws.
Histograms cover all labelled rows; only one number for each rule (or stratum) and cutoff reaches the
driver.  Rows labelled more than once count as good if every label says so.  Null texts have
no words and fail the base rules; null strata are a stratum of their own; repeated rows get
equal results; an empty table gives an empty result, and without labels no rule applies.  Texts are
measured whole, however long.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed

RISK, CONFIDENCE, STEPS = 0.02, 0.95, 64
#: Share of the labelled texts that put the cutoffs in order, and by how much a cutoff must reject poor texts more often.
TUNING, LEAST_LIFT = 0.25, 3.0
_SYMBOLS = bytes(ord(c) for c in "#*$%&|<>")
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_WINDOW = 3


def rules() -> dict[str, Column]:
    """Value of each rule in 0..STEPS, larger is worse."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = {
        "symbols": F.col("n_symbols") / chars,
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_words": F.greatest(chars / words - 4, F.lit(0)) / 16,
        "short_text": F.lit(50.0) / F.greatest(words, F.lit(50)),
    }
    return {k: F.least(F.ceil(x * STEPS), F.lit(STEPS)).cast("int") for k, x in share.items()}


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw.translate(None, _NOT_SYMBOLS)), 0, 0, 0
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= len(raw) - len(raw.translate(None, _CONTINUED))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= _WINDOW:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, n)
        if len(known) < n:
            wide = len(known)
            pairs = ids[:-2] * wide + ids[1:-1]
            if wide < 1 << 20:
                _, which, many = np.unique(pairs * wide + ids[2:], return_inverse=True, return_counts=True)
            else:  # three numbers don't fit 63 bits: number the pairs first
                _, pairs = np.unique(pairs, return_inverse=True)
                _, which, many = np.unique(pairs * wide + ids[2:], return_inverse=True, return_counts=True)
            begins = np.flatnonzero(many[which] > 1)
            covered = np.zeros(n, bool)
            for k in range(_WINDOW):
                covered[begins + k] = True
            repeated = int(covered.sum())
    return n, chars, len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(df: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(id, stratum, draw, features) of every row; ``draw`` is a hash of the text."""
    shape = df.select(
        F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("draw"),
    )
    kind = shape.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text=2):
            rows = np.array([measure(x) for x in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *[pa.array(c) for c in rows.T.copy()]],
                ["id", "stratum", "draw", *FEATURES],
            )

    return shape.mapInArrow(run, f"id {kind}, stratum string, draw long, " + ", ".join(f"{x} long" for x in FEATURES))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    whole = d
    for m in range(1, 10_000):
        change = 1.0
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            change = c * d
            whole *= change
        if abs(change - 1) < 1e-14:
            break
    return math.exp(log) * whole / a


def upper_bound(bad: int, n: int, alpha: float) -> float:
    """The exact (Clopper-Pearson) upper limit of a share, ``bad`` of ``n`` seen."""
    if n == 0 or bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        # the chance to see at most ``bad`` falls as the share grows
        if 1 - _beta_share(bad + 1, n - bad, middle) <= alpha:
            high = middle
        else:
            low = middle
    return high


def cutoff_order(good: dict[str, dict[int, int]], poor: dict[str, dict[int, int]]) -> list[tuple[str, int]]:
    """(rule, lowest value rejected) in the order of the share of good texts that they reject.

    Both arguments have for each rule how many texts have each value.  Of one rule the milder
    cutoff always stands before.
    """
    found = []
    for place, rule in enumerate(rules()):
        n_good, n_poor = sum(good.get(rule, {}).values()), sum(poor.get(rule, {}).values())
        bad = hit = 0
        for value in range(STEPS, 0, -1):
            bad += good.get(rule, {}).get(value, 0)
            hit += poor.get(rule, {}).get(value, 0)
            if hit * max(n_good, 1) >= LEAST_LIFT * bad * max(n_poor, 1) and hit:
                found.append((bad / max(n_good, 1), place, -value, rule))
    return [(rule, -value) for _, _, value, rule in sorted(found)]


def accepted(rejected: dict[int, int], n: int, steps: int, alpha: float, risk: float) -> int:
    """How many cutoffs of the order a stratum takes.

    ``rejected`` has how many good texts of ``n`` are first rejected by each.
    """
    bad = 0
    for step in range(steps):
        bad += rejected.get(step, 0)
        if bad > risk * n or upper_bound(bad, n, alpha) > risk:
            return step
    return steps


def judge(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    good_col: str = "quality",
    risk: float = RISK,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(id, features, base_failed, kept, failed_rules) of every row."""
    rows = checkpointed(features(df, id_col, text_col, stratum_col))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = rows.withColumn("base_failed", base_failed).withColumns(rules())
    names = list(rules())
    known = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.min(good_col).alias("good"))
    # what the base rules reject is none of the learned rules' doing; equal texts have equal values
    texts = (
        values.where(~F.col("base_failed")).join(known, F.col("id") == F.col("labelled"))
        .groupBy("stratum", "draw", *names).agg(F.min("good").alias("good"))
        .withColumn("tuning", F.pmod(F.xxhash64("draw"), F.lit(1000)) < int(1000 * TUNING))
    )
    texts = checkpointed(texts)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(x).alias("value")) for x in names]))
    histogram: dict[bool, dict[str, dict[int, int]]] = {True: {}, False: {}}
    for x in texts.where("tuning").select("good", each.alias("r")).groupBy((F.col("good") == 1).alias("good"), "r.rule", "r.value").count().collect():
        histogram[x["good"]].setdefault(x["rule"], {})[x["value"]] = x["count"]
    order = cutoff_order(histogram[True], histogram[False])
    holdout = texts.where("not tuning and good = 1").withColumn("first", _first_step(order))
    by_stratum: dict[str | None, dict[int | None, int]] = {}
    for x in holdout.groupBy("stratum", "first").count().collect():
        by_stratum.setdefault(x["stratum"], {})[x["first"]] = x["count"]
    alpha = (1 - confidence) / max(1, len(by_stratum))
    taken = {s: accepted(n, sum(n.values()), len(order), alpha, risk) for s, n in by_stratum.items()}
    steps = F.lit(0)
    if taken:
        keyed = F.create_map(*[F.lit(y) for s, n in taken.items() for y in (f"s{s}" if s is not None else "n", n)])
        steps = F.coalesce(keyed[F.coalesce(F.concat(F.lit("s"), F.col("stratum")), F.lit("n"))], F.lit(0))
    fails = [F.when(_first_step(order, rule) < steps, F.lit(rule)) for rule in names]
    failed = F.array_compact(F.array(*fails))
    return values.withColumn("failed_rules", failed).select(
        F.col("id").alias(id_col), *FEATURES[:5], "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def _first_step(order: list[tuple[str, int]], rule: str | None = None) -> Column:
    """The first cutoff in the order (of one rule or of all) that rejects a row; null if none does."""
    steps = []
    for name in rules():
        own = {value: step for step, (x, value) in enumerate(order) if x == name}
        if own and rule in (None, name):
            # a value is rejected by the cutoffs at or below it, of which the highest comes first
            first = [own[max(c for c in own if c <= v)] if min(own) <= v else None for v in range(STEPS + 1)]
            steps.append(F.array(*[F.lit(x).cast("int") for x in first])[F.col(name)])
    if not steps:
        return F.lit(None).cast("int")
    return F.least(*steps) if len(steps) > 1 else steps[0]
