"""Images as rows: decoded by Spark's image reader, hashed and compared in Arrow batches."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..operators.similar import ensure_checkpoints

SCHEMA = (
    "path string, width int, height int, taken long, phash long, dhash long, "
    "variants array<struct<p:long,d:long>>, pixels binary, sketch binary, error string"
)


#: Why an image has no hashes; only the last is found by decoding.
UNKNOWN, TOO_LARGE = "unsupported or unrecognised image format", "image too large (decompression bomb)"
CORRUPT = "corrupt or truncated image"


def hashed(files: DataFrame) -> DataFrame:
    """One row per image of ``files`` (path); those that can't be decoded have an error.

    Exactly the given files are read, whatever their names: each gets a link with a plain name in a
    shared folder, which Spark's image reader reads (JPEG, PNG, GIF, BMP).  Only the small working
    copies and a few tags are shuffled, never pixels or contents.  Headers tell beforehand what isn't an image
    or is too large, so that its pixels are never made.  Images without content to
    compare have no variants; a sketch is made only where the capture time is known.
    """
    spark = files.sparkSession
    stage = f"{ensure_checkpoints(spark)}/images-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    if "://" in stage:
        raise ValueError("images are read through links, which needs a checkpoint folder on a mounted path")
    os.makedirs(f"{stage}/none")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_linked(stage, x) for x in batch["path"]], columns=["path", "name", "turned", "taken", "error"])

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_shrunk(x) for x in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["link", "h", "w", "upright"])

    linked = files.select("path").mapInPandas(link, "path string, name string, turned int, taken long, error string").checkpoint()
    decoded = (
        spark.read.format("image").options(dropInvalid="false", recursiveFileLookup="true").load(stage)
        .select("image.*").mapInPandas(shrink, "link string, h int, w int, upright binary").where("upright is not null")
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_row(x) for x in batch.itertuples()], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return linked.join(decoded, F.col("name") == F.col("link"), "left").mapInPandas(finish, SCHEMA)


def _linked(stage: str, path: str) -> tuple:
    name = hashlib.sha1(path.encode()).hexdigest()
    folder = f"{stage}/{name[:2]}"
    try:
        with open(path, "rb") as file:
            shape = images.dimensions(file)
            file.seek(0)
            tags = images.exif(file)
        if shape is None:
            return path, name, None, None, UNKNOWN
        if shape[0] * shape[1] > images.MOST_PIXELS:
            return path, name, None, None, TOO_LARGE
        os.makedirs(folder, exist_ok=True)
        place = f"{folder}/{name}{os.path.splitext(path)[1].lower()}"
        if not os.path.islink(place):  # a task that runs again finds its links
            os.symlink(path, place)
    except FileExistsError:
        pass
    except OSError as problem:
        return path, name, None, None, problem.strerror or type(problem).__name__
    return path, name, tags.get(images.ORIENTATION, 1), images.capture_seconds(tags), None


def _shrunk(x) -> tuple:
    name = os.path.splitext(os.path.basename(x.origin))[0]
    if x.width <= 0 or not x.data:
        return name, None, None, None
    bgr = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels)
    return name, x.height, x.width, images.working_copy(images.gray(bgr)).tobytes()


def _row(x) -> tuple:
    if x.upright is None or pd.isna(x.h):
        return x.path, None, None, None, None, None, [], None, None, x.error or CORRUPT
    copy = np.frombuffer(x.upright, np.uint8).reshape(images.WORK, images.WORK)
    copy = np.ascontiguousarray(images.oriented(copy, int(x.turned)))
    width, height = (int(x.w), int(x.h)) if x.turned < 5 else (int(x.h), int(x.w))
    taken = None if pd.isna(x.taken) else int(x.taken)
    found = images.hashes(copy)
    sketch = images.sketch(copy).tobytes() if found and taken is not None else None
    first = found[0] if found else (None, None)
    variants = [{"p": p, "d": d} for p, d in found]
    return x.path, width, height, taken, *first, variants, copy.tobytes(), sketch, None


def verified(candidates: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """(i, j, variant, distance, similarity): accepted by their hashes, or else by their pixels.

    ``rows`` has (idx, pixels, sketch).  Shots found by capture time are compared on their
    sketches, which may differ more.
    """
    near = (F.col("dp") <= threshold) & (F.col("dd") <= threshold)
    by_hash = candidates.where(near).select("i", "j", "variant", F.col("dp").alias("distance"), (1 - F.col("dp") / 64).alias("similarity"))
    source = lambda k: rows.select(F.col("idx").alias(k), F.col("pixels").alias(f"pixels_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    rest = candidates.where(~near).join(source("i"), "i").join(source("j"), "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for by_time, rows in batch.groupby(batch["by_time"].astype(bool)):
                what, side, bar = ("sketch", images.SKETCH, images.SCENE_BAR) if by_time else ("pixels", images.WORK, images.SSIM_BAR)
                rows = rows.dropna(subset=[f"{what}_i", f"{what}_j"])
                for first in range(0, len(rows), STACK):
                    part = rows[first : first + STACK]
                    a, b = (_stacked(part[f"{what}_{k}"], side) for k in "ij")
                    a = np.stack([images.variant(x, k) for x, k in zip(a, part["variant"])])
                    score = images.aligned_ssims(a, b, bar)
                    good = part[score >= bar]
                    yield pd.DataFrame({"i": good["i"], "j": good["j"], "variant": good["variant"], "distance": good["dp"], "similarity": score[score >= bar]})

    return by_hash.unionByName(rest.mapInPandas(run, "i long, j long, variant int, distance int, similarity double"))


#: Pairs that are compared together.
STACK = 256


def _stacked(packed: pd.Series, side: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), side, side)


def structural_similarity(pairs: DataFrame, side: int) -> DataFrame:
    """(i, j, similarity) of pairs (i, j, a, b) of square images in bytes, as they lie, in stacks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), STACK):
                part = batch[first : first + STACK]
                score = images.ssims(_stacked(part["a"], side), _stacked(part["b"], side))
                yield pd.DataFrame({"i": part["i"], "j": part["j"], "similarity": score})

    return pairs.select("i", "j", "a", "b").mapInPandas(run, "i long, j long, similarity double")
