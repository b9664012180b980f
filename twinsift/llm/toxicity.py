"""Toxicity by a chain of linear classifiers over the categories that labels name.

Categories are predicted one after the other: each is a logistic regression on the words and
word beginnings of a vocabulary and on the probabilities of the categories before it.  In training those
probabilities are out-of-fold (models of the other folds make them), so that a later model
learns from what it will see; folds are dealt by a hash of the text, which keeps copies in
one fold.  For prediction each category's model is fitted once more on all folds.

The vocabulary has the words that go along with a category by a chi-squared statistic.  It
counts distinct contexts (a word with its neighbours), so that a text copied many times
counts once.  The classifier, its vocabulary included, is fitted on a bounded sample of the
labelled rows: ``SAMPLE`` at most, those whose texts have the lowest stable hashes; equal texts with
equal labels count once.

Null texts are read as empty and get the probabilities of a text without known words.  A
null label leaves its row out of that category only; rows labelled twice count with
the larger label.  Without any labels every probability is 0; an empty table gives an empty
result.  Very long texts are counted whole.  Repeated rows get equal results.  Columns other than
id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed

SAMPLE, FOLDS, WORDS, LEAST_CHI2, LEAST_CONTEXTS = 10_000, 5, 120, 40.0, 12
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7)
THRESHOLD = 0.5
_GAPS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().encode().translate(_GAPS).decode().split()


@dataclass
class Chain:
    """Categories in order, each with its vocabulary and weights (words, earlier, constant)."""

    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """Damped counts of the vocabulary's features."""
        out = np.zeros((len(texts), len(self.vocabulary)))
        get = self.vocabulary.get
        for row, text in zip(out, texts):
            for word, n in Counter(words_of(text)).items():
                if (at := get(word)) is not None:
                    row[at] += n
                for size in BEGINNINGS:
                    if len(word) >= size and (at := get(f"{word[:size]}*")) is not None:
                        row[at] += n
        return np.log1p(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category."""
        found = np.zeros((len(x), len(self.categories)))
        for c, w in enumerate(self.weights):
            found[:, c] = probability(_with(x, found[:, :c]), w)
        return found


def _with(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.hstack([x, earlier, np.ones((len(x), 1))])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights by Newton's method; the last column, the constant, isn't held small."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = probability(x, w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(chain: Chain, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """``y`` has a column for each category, NaN where the label is unknown."""
    earlier = np.zeros((len(x), 0))
    for c in range(len(chain.categories)):
        here = _with(x, earlier)
        known = ~np.isnan(y[:, c])
        if not known.any():
            chain.weights.append(np.append(np.zeros(here.shape[1] - 1), -30.0))
            earlier = np.hstack([earlier, np.zeros((len(x), 1))])
            continue
        out = np.zeros(len(x))
        for f in range(FOLDS):
            use = known & (fold != f)
            if use.any():
                out[fold == f] = probability(here[fold == f], logistic(here[use], y[use, c]))
        chain.weights.append(logistic(here[known], y[known, c]))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def _contexts(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(word, context, labels...) of the distinct contexts of every text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text=0, most_bytes=1 << 20):
            word, context, row = [], [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = words_of(text)
                padded = " ".join(["", *words, ""]).encode().split(b" ")
                seen = {(w, xxhash.xxh64_intdigest(b" ".join(padded[k : k + 3])) >> 1) for k, w in enumerate(words)}
                for w, c in seen:
                    word.append(w), context.append(c), row.append(i)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(context, pa.int64()), *[c.take(at) for c in batch.columns[1:]]],
                ["word", "context", *categories],
            )

    kinds = ", ".join(f"`{c}` int" for c in categories)
    return rows.select("text", *categories).mapInArrow(run, f"word string, context long, {kinds}")


def vocabulary(rows: DataFrame, categories: Sequence[str]) -> dict[str, int]:
    """At most ``WORDS`` features for each category, those with the largest statistics."""
    once = _contexts(rows, categories).groupBy("word", "context").agg(*[F.max(c).alias(c) for c in categories])
    starts = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    by_word = once.groupBy("word").agg(
        *[F.sum(c).alias(f"yes_{c}") for c in categories], *[F.count(c).alias(f"all_{c}") for c in categories]
    )
    distinct = by_word.withColumn("word", F.explode(F.array_compact(F.array("word", *starts))))
    counted = checkpointed(
        distinct.groupBy("word").agg(*[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in categories for k in ("yes", "all")])
    )
    # words and beginnings together: a share's scale, not a count of texts
    totals = counted.agg(*[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in categories for k in ("yes", "all")]).first()
    words: set[str] = set()
    totals = totals.asDict()
    for c in categories:
        n, yes = totals[f"all_{c}"] or 0, totals[f"yes_{c}"] or 0
        if not 0 < yes < n:
            continue
        share, seen = yes / n, F.col(f"all_{c}")
        chi2 = (F.col(f"yes_{c}") - seen * share) ** 2 / (seen * share * (1 - share))
        best = counted.where(seen >= LEAST_CONTEXTS).select("word", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2)
        words |= {x["word"] for x in best.orderBy(F.desc("chi2"), "word").limit(WORDS).collect()}
    return {w: i for i, w in enumerate(sorted(words))}


def sampled(
    df: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id",
    text_col: str = "text", sample: int = SAMPLE,
) -> DataFrame:
    """(draw, categories..., text) of ``sample`` labelled texts at most, equal ones with equal labels once.

    ``categories`` maps names, in the chain's order, to SQL expressions over ``labels`` that give 0 or 1.
    """
    names = list(categories)
    once = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(
        *[F.max(F.expr(x).cast("int")).alias(c) for c, x in categories.items()]
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("draw"))
    # narrow rows first: which draws are taken
    drawn = rows.select("id", "draw").join(once, F.col("id") == F.col("labelled")).groupBy("draw", *names).agg(F.min("id").alias("id"))
    lowest = checkpointed(drawn.orderBy("draw", *names).limit(sample))
    return rows.select("id", "text").join(
        F.broadcast(lowest.withColumnRenamed("id", "taken")), F.col("id") == F.col("taken")  # ``sample`` rows at most
    ).where(F.xxhash64("text") == F.col("draw")).select("draw", *names, "text").dropDuplicates(["draw", *names])


def train(
    df: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> Chain:
    """Fit vocabulary and weights; the same rows always give the same chain."""
    names = list(categories)
    chosen = checkpointed(sampled(df, labels, categories, id_col, text_col, sample))
    chain = Chain(names)
    if chosen.isEmpty():
        return chain
    chain.vocabulary = vocabulary(chosen, names)
    known = chain
    fields = ", ".join(f"`{c}` double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text=0):
            x = known.matrix(batch.column(0).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[1:]], ["x", "draw", *names]
            )

    found = chosen.select("text", "draw", *[F.col(c).cast("double").alias(c) for c in names])
    got = found.mapInArrow(run, f"x binary, draw long, {fields}").toPandas().sort_values(["draw", *names])
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], np.float64).reshape(len(got), len(chain.vocabulary))
    return fit_chain(chain, x, got[names].to_numpy(float), (got["draw"] % FOLDS).to_numpy())


def predict(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(chain)  # its size is fixed by its parameters
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            model = shared.value
            found = model.predict(model.matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in found.T.copy()]], [id_col, *names])

    fields = ", ".join(f"`{x}` double" for x in names)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")


def classify(
    df: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id",
    text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, p_<category>..., <last category>): whether the last probability reaches the threshold."""
    chain = train(df, labels, categories, id_col, text_col)
    last = chain.categories[-1]
    return predict(df, chain, id_col, text_col).withColumn(last, F.col(f"p_{last}") >= threshold)
