"""Hashes of images seen before: a nested table, keyed by a file's version and the algorithm's stamp.

Working copies, which only the check of pixels needs, are a column of their own, so that a look-up of
hashes doesn't read them.  Text forms are for exchange with tools that keep one string for an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from . import store
from .snapshot import VERSION

#: Changes with anything that changes a hash, a sketch or a working copy.
ALGO = f"copy{images.WORK}-lanczos3-dct8-steps8-sketch{images.SKETCH}-1"
VALUES = ("width", "height", "taken", "phash", "dhash", "variants", "pixels", "sketch")
SCHEMA = (
    "path string, size long, mtime_ns long, inode long, device long, algo string, width int, height int, taken long, "
    "phash long, dhash long, variants array<struct<p:long,d:long>>, pixels binary, sketch binary"
)
N_VARIANTS = 8


def folder_of(cache: str) -> str:
    return f"{cache.rstrip('/')}-images"


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, str | None]:
    """The table, and a warning in place of one that can't be read; none yet is an empty one."""
    try:
        rows = store.read(spark, folder, SCHEMA)
        if rows is not None:
            rows.isEmpty()
            return rows, None
        return spark.createDataFrame([], SCHEMA), None
    except Exception as problem:
        return spark.createDataFrame([], SCHEMA), f"image snapshot unavailable: {type(problem).__name__}"


def save(rows: DataFrame, folder: str) -> None:
    store.publish(rows.select(*[x.split()[0] for x in SCHEMA.split(", ")]), folder)


def hits(files: DataFrame, known: DataFrame, algo: str = ALGO) -> DataFrame:
    """(path, values...) of the files that ``known`` has in this very version, by this very algorithm.

    Each row of ``known`` comes once, however many files or rows share its path.
    """
    current = known.where(F.col("algo") == algo).select("path", *VERSION, *VALUES)
    return current.join(files.select("path", *VERSION), ["path", *VERSION], "left_semi").select("path", *VALUES)


def states(files: DataFrame, known: DataFrame, algo: str = ALGO) -> DataFrame:
    """(path, state): ``hit``, or why a file is decoded anew: ``new``, ``changed`` or ``stamp``.

    Each file comes once; of several known rows of its path the one nearest to a hit counts.
    """
    there = known.select("path", F.lit(True).alias("there")).distinct()
    stamped = known.groupBy("path", *VERSION).agg(F.max(F.coalesce(F.col("algo") == algo, F.lit(False))).alias("stamped"))
    rows = files.select("path", *VERSION).join(there, "path", "left").join(stamped, ["path", *VERSION], "left")
    state = F.when(F.col("there").isNull(), "new").when(F.col("stamped").isNull(), "changed").when(~F.col("stamped"), "stamp").otherwise("hit")
    return rows.select("path", state.alias("state"))


def renewed(known: DataFrame, fresh: DataFrame, algo: str = ALGO) -> DataFrame:
    """``known`` with fresh rows (path, version, values) in place of those of their paths."""
    new = fresh.select("path", *VERSION, F.lit(algo).alias("algo"), *VALUES)
    return known.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def to_text(width: Column, height: Column, taken: Column, variants: Column, sketch: Column) -> Column:
    """``width,height[,taken];16 + 16 hexadecimal digits for each variant, with semicolons[|sketch in base 64]``."""
    head = F.concat_ws(",", width.cast("string"), height.cast("string"), taken.cast("string"))
    body = F.array_join(F.transform(variants, lambda v: F.concat(_hex(v["p"]), _hex(v["d"]))), ";")
    tail = F.when(F.length(sketch) > 0, F.concat(F.lit("|"), F.regexp_replace(F.base64(sketch), r"\s", ""))).otherwise("")
    return F.concat(head, F.lit(";"), body, tail)


def _unhex(text: Column) -> Column:
    """A signed integer of 16 hexadecimal digits."""
    halves = [F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def from_text(text: Column) -> Column:
    """(width, height, taken, variants, sketch) of a text form; null for one that is malformed in any way."""
    digits = r"-?[0-9]{1,18}"
    item = r"[0-9a-fA-F]{32}"
    form = rf"^-?[0-9]{{1,9}},-?[0-9]{{1,9}}(,{digits})?;({item}(;{item}){{{N_VARIANTS - 1}}})?(\|[A-Za-z0-9+/]*={{0,2}})?$"
    head, rest = F.split_part(text, F.lit(";"), F.lit(1)), F.split_part(text, F.lit("|"), F.lit(1))
    body = F.substring(rest, F.length(head) + 2, F.length(rest))
    numbers = F.split(head, ",")
    encoded = F.split_part(text, F.lit("|"), F.lit(2))
    side = images.SKETCH * images.SKETCH
    whole = (F.length(encoded) == 0) | ((F.length(encoded) == -(-side // 3) * 4) & (F.length(F.regexp_replace(encoded, "=+$", "")) == -(-side * 8 // 6)))
    found = F.struct(
        F.get(numbers, F.lit(0)).cast("int").alias("width"), F.get(numbers, F.lit(1)).cast("int").alias("height"),
        F.get(numbers, F.lit(2)).cast("long").alias("taken"),
        F.transform(F.filter(F.split(body, ";"), lambda v: F.length(v) > 0), lambda v: F.struct(
            _unhex(F.substring(v, 1, 16)).alias("p"), _unhex(F.substring(v, 17, 16)).alias("d")
        )).alias("variants"),
        F.when(F.length(encoded) > 0, F.unbase64(encoded)).alias("sketch"),
    )
    return F.when(text.rlike(form) & whole, found)
