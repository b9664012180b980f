"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

A text's letters are lower-cased, everything else becomes a gap between words, and its
n-grams of one to three characters are counted in ``WIDTH`` hashed places.  Counts are damped,
weighted by inverse document frequency and scaled to length one.  Each language has several
centroids (spherical k-means over its sample), and a text gets the language of the centroid
with the largest cosine, which is its score.  Few letters give a small cosine in any
language, so the least cosine is found for each band of lengths: that which all but one in a
thousand of the winning language's own sample reach, its whole texts in the band and the
beginnings of all texts (without repeated words), cut to the band's least number of letters.  A text is rejected if
its cosine is less than this by more than the factor ``slack`` (and its distance larger than
``LEAST_REACH``), or if it has no letter.

The model is fitted on a bounded sample: of each of the ``LANGUAGES`` most frequent languages
``SAMPLE`` distinct texts at most, those whose stable hashes are lowest.  Counts for this cover
all rows; a sampled text is counted where it is read, and only its counts reach the driver.

Null texts and texts without a letter (marks alone are none) are ``und`` with score 0, and
rejected.  Without any learned language every text is; an empty table gives an empty result.  Very
long texts are counted whole, in blocks.  Repeated rows get equal results, ties go to the
language that sorts first.  Columns other than id and text don't reach a prediction.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks

WIDTH, GRAMS = 1 << 13, 3
#: Distinct texts of each language that the model is fitted on, its centroids, and how many languages.
SAMPLE, CENTROIDS, LANGUAGES = 800, 4, 256
#: No text nearer than this is rejected, however alike the sample's texts are.
LEAST_REACH = 0.75
#: Least number of letters of each band of lengths.
BANDS = (1, 2, 4, 8, 16, 32, 64, 128)
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower case of each code point that is a letter or a mark; 0 for all others."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = ord(chr(c).lower()[0])
    return table


@lru_cache(1)
def is_letter() -> np.ndarray:
    """Whether each code point is a letter; marks belong to n-grams but are none."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> tuple[np.ndarray, int] | None:
    """How often each hashed n-gram occurs in the whole text, and its letters; None if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    total = np.zeros(WIDTH)
    n_letters = 0
    for first in range(0, len(points), 1 << 20):  # two characters more for n-grams across
        part = letters()[points[max(0, first - GRAMS + 1) : first + (1 << 20)]]
        n_letters += int(np.count_nonzero(is_letter()[points[first : first + (1 << 20)]]))
        grams = part * np.uint32(0x9E3779B1)
        for n in range(1, GRAMS + 1):
            if n > 1:
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + part[n - 1 :]
            skip = max(0, (GRAMS - 1 if first else 0) - n + 1)
            place = (grams[skip:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - WIDTH.bit_length() + 1)
            total += np.bincount(place, minlength=WIDTH)
    return (total.astype(np.float32), n_letters) if n_letters else None


def beginnings(text: str) -> list[str]:
    """A text's distinct words in their order, up to the least letters of each band that they fill."""
    words, n = {}, 0
    for found in re.finditer(r"\S+", text):
        if found[0] not in words:
            words[found[0]] = None
            n += np.count_nonzero(is_letter()[np.frombuffer(found[0][: 2 * BANDS[-1]].encode("utf-32-le"), "<u4")])
            if n >= BANDS[-1]:
                break
    joined = " ".join(words)
    at = np.flatnonzero(is_letter()[np.frombuffer(joined.encode("utf-32-le"), "<u4")])
    return [joined[: int(at[least - 1]) + 1] for least in BANDS if least <= len(at)]


def band(n_letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, n_letters, "right") - 1


@dataclass
class Model:
    """``centroids`` has a row for each, ``labels`` its language, ``reach`` its largest distance in each band."""

    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    reach: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        found = np.array(rows, np.float32).reshape(len(rows), WIDTH)
        np.log1p(found, out=found)
        found *= self.idf.astype(np.float32)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text is rejected."""
        found = [counts(x) if self.labels else None for x in texts]
        some = [i for i, x in enumerate(found) if x is not None]
        labels = [UNKNOWN] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        if some:
            cosine = self.vectors([found[i][0] for i in some]) @ self.centroids.T
            best = cosine.argmax(1)
            top = cosine[np.arange(len(some)), best]
            for i, b in zip(some, best.tolist()):
                labels[i] = self.labels[b]
            score[some] = np.clip(top, 0, 1)
            rejected[some] = 1 - top > self.reach[best, band(np.array([found[i][1] for i in some]))]
        return labels, score, rejected


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS, slack: float = 1.75) -> Model:
    """From (language, text) pairs; the same pairs always give the same model."""
    found = [(lang, *x, beginnings(text)) for lang, text in sorted(samples) if (x := counts(text)) is not None]
    return fit_counts(found, centroids, slack)


def fit_counts(kept: list[tuple[str, np.ndarray, int, list[str]]], centroids: int = CENTROIDS, slack: float = 1.75) -> Model:
    """The same from languages, counts, numbers of letters and beginnings, in a stable order."""
    none = np.zeros((0, len(BANDS)))
    if not kept:
        return Model(np.ones(WIDTH), np.zeros((0, WIDTH), np.float32), [], none)
    seen = np.zeros(WIDTH)
    for _, x, _, _ in kept:
        seen += x > 0
    model = Model(np.log((1 + len(kept)) / (1 + seen)) + 1, np.zeros((0, WIDTH)), [], none)
    rows, reach = [], []
    for lang in sorted({x[0] for x in kept}):
        own = [x[1:] for x in kept if x[0] == lang]
        x = model.vectors([row for row, _, _ in own])
        middle = x[np.linspace(0, len(x) - 1, min(centroids, len(x))).astype(int)]
        for _ in range(12):
            nearest = (x @ middle.T).argmax(1)
            sums = np.array([x[nearest == c].sum(0) if (nearest == c).any() else middle[c] for c in range(len(middle))])
            middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        whole, n_letters = (x @ middle.T).max(1), np.array([n for _, n, _ in own])
        del x
        first, far = [x for _, _, x in own], np.full(len(BANDS), LEAST_REACH)
        for b in reversed(range(len(BANDS))):
            cut = model.vectors([counts(x[b])[0] for x in first if b < len(x)])
            near = np.concatenate([(cut @ middle.T).max(1, initial=0), whole[band(n_letters) == b]])
            if len(near):
                far[b] = max(LEAST_REACH, 1 - float(np.quantile(near, 0.001)) / slack)
            if b + 1 < len(BANDS):  # fewer letters never tell more
                far[b] = max(far[b], far[b + 1])
        for one in middle:
            rows.append(one), model.labels.append(lang), reach.append(far)
    model.centroids, model.reach = np.array(rows, np.float32), np.array(reach)
    return model


def train(
    df: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> Model:
    """Fit on the rows that ``usable`` allows and whose language is known."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("draw"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("texts"))
    frequent = counted.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not frequent:
        return fit([])
    # more than are wanted, as their number is an estimate; then the lowest of them
    span = float(1 << 63)
    rate = F.create_map(*[F.lit(x) for r in frequent for x in (r["lang"], min(1.0, 4 * sample / r["texts"]))])
    near = rows.where((F.col("draw").cast("double") + span) / (2 * span) < rate[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # as many as the sample, at most
        for batch in blocks(batches):
            out = []
            for lang, text, draw in zip(*[c.to_pylist() for c in batch.columns]):
                if (lang, draw) not in seen and (found := counts(text)) is not None:
                    at = np.flatnonzero(found[0])
                    packed = at.astype("<u2").tobytes() + found[0][at].astype("<f4").tobytes()
                    out.append((lang, draw, packed, found[1], beginnings(text)))
                seen.add((lang, draw))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.string())))],
                ["lang", "draw", "packed", "n_letters", "first"],
            )

    counted = near.mapInArrow(run, "lang string, draw long, packed binary, n_letters long, first array<string>")
    lowest = Window.partitionBy("lang").orderBy("draw")
    chosen = counted.dropDuplicates(["lang", "draw"]).withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= sample)
    kept = []
    for x in sorted(chosen.collect(), key=lambda x: (x["lang"], x["draw"])):
        n, row = len(x["packed"]) // 6, np.zeros(WIDTH, np.float32)
        row[np.frombuffer(x["packed"][: 2 * n], "<u2")] = np.frombuffer(x["packed"][2 * n :], "<f4")
        kept.append((x["lang"], row, x["n_letters"], x["first"]))
    return fit_counts(kept)


def usable_rows(id_col: str = "doc_id") -> Column:
    """Not held out: the id's checksum leaves another remainder than 1 by 3."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 3 == 1


def predict(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: str
) -> DataFrame:
    """(id, more..., lang_pred, score, rejected) of every row."""
    columns = list(dict.fromkeys([id_col, text_col, *more]))
    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in columns if x != text_col or text_col in more)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 128 KiB a language, ``LANGUAGES`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                labels, score, rejected = shared.value.predict(part.column(1).to_pylist())
                keep = [i for i, x in enumerate(columns) if x != text_col or text_col in more]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array(labels), pa.array(score), pa.array(rejected)],
                    [*[columns[i] for i in keep], "lang_pred", "score", "rejected"],
                )

    return df.select(*columns).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), learned from the rows that aren't held out."""
    model = train(df, usable_rows(id_col), id_col, text_col, lang_col)
    found = predict(df, model, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
