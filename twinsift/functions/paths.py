"""Expressions over paths and file names, all inside the JVM.

Paths are absolute, with ``/`` between components.  Two orders matter: that of whole strings
and that of components (``components`` sorts as the latter).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from fnmatch import translate
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What folder names hint at, and what names of copies look like.
DISPOSABLE_WORDS = ("downloads", "tmp", "trash", "cache", "backup", "copy", "old")
COPY_NAME = r"(?U)(?i)\bcopy\b|\(\d+\)|_\d+$|\.bak$"

#: Extensions by category; all others are OTHER.
OTHER = "Other"
CATEGORIES = {
    "Images": ".jpg .jpeg .png .gif .webp .bmp .tif .tiff .heic .heif .avif .svg .ico .raw .cr2 .nef .arw .dng",
    "Video": ".mp4 .mkv .mov .avi .wmv .flv .webm .m4v .mpg .mpeg .3gp",
    "Audio": ".mp3 .flac .wav .ogg .oga .m4a .aac .opus .wma .aiff",
    "Documents": ".pdf .doc .docx .odt .rtf .txt .md .xls .xlsx .ods .csv .ppt .pptx .odp .epub .tex",
    "Archives": ".zip .tar .gz .tgz .bz2 .xz .7z .rar .zst .iso .deb .rpm",
}
#: Images that hold no pixels of their own, icons and camera raw formats.
NOT_RASTER = ".svg .ico .raw .cr2 .nef .arw .dng".split()
NEEDS_CODEC = ".heic .heif".split()
RASTER = [x for x in CATEGORIES["Images"].split() if x not in NOT_RASTER]


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """With its dot; empty for names without one, or with one in front only."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.substring(name(path), F.lit(1), F.length(name(path)) - F.length(suffix(path)))


def depth(path: Column) -> Column:
    """What makes a path short: its components, then its length."""
    return F.struct(F.size(components(path)).alias("components"), F.length(path).alias("length"))


def is_under(path: Column, folder: str) -> Column:
    """The folder itself or something inside it; not just a common beginning."""
    folder = folder.rstrip("/")
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


def is_protected(path: Column, folders: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (is_under(path, f) for f in folders), F.lit(False))


def in_disposable_folder(path: Column, root: str | None = None) -> Column:
    """Whether a folder below the root (any folder, for paths elsewhere) hints at leftovers."""
    folder = parent(path)
    if root is not None:
        inside = F.substring(folder, F.lit(len(root.rstrip("/")) + 1), F.length(folder))
        folder = F.when(is_under(folder, root), inside).otherwise(folder)
    return F.arrays_overlap(F.split(F.lower(folder), "[^a-z0-9]+"), F.array(*map(F.lit, DISPOSABLE_WORDS)))


def looks_like_copy(path: Column) -> Column:
    """By the whole name or by the name without its suffix."""
    return name(path).rlike(COPY_NAME) | stem(path).rlike(COPY_NAME)


def category(path: Column) -> Column:
    pairs = [F.lit(x) for kind, ends in CATEGORIES.items() for end in ends.split() for x in (end, kind)]
    return F.coalesce(F.create_map(*pairs)[F.lower(suffix(path))], F.lit(OTHER))


def is_raster(path: Column, codec: bool = False) -> Column:
    kept = [x for x in RASTER if codec or x not in NEEDS_CODEC]
    return F.lower(suffix(path)).isin(kept)


def _glob(pattern: str) -> str:
    """A shell pattern for Java: anchored at the very end, where a line break counts."""
    body = translate(pattern)
    return r"\A" + re.sub(r"\\[Zz]$", "", body) + r"\z"


def is_excluded(path: Column, patterns: Iterable[str]) -> Column:
    """Whether the path or a folder above it matches.

    ``/x`` is a path and all below; without a slash a pattern is held against each name;
    with one, against whole paths and their ends.
    """
    found = F.lit(False)
    parts = components(path)
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    def any_matches(texts: Column, *globs: str) -> Column:
        return F.exists(texts, lambda x: reduce(lambda p, q: p | q, [x.rlike(_glob(g)) for g in globs]))

    for pattern in patterns:
        if pattern.startswith("/"):
            found = found | is_under(path, pattern)
        elif "/" in pattern:
            found = found | any_matches(above, pattern, "*/" + pattern)
        else:
            found = found | any_matches(parts, pattern)
    return found


def is_hidden(path: Column, root: str) -> Column:
    """Whether a component below the root begins with a dot."""
    inside = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path))
    return F.exists(components(inside), lambda x: F.startswith(x, F.lit(".")))


def human_size(n: Column) -> Column:
    """B as whole numbers, then one decimal place up to TiB; halves go to the even digit."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, shown).otherwise(out)
    return out


#: The letter of each kind of file, by the mode's bits from the twelfth on.
KINDS_OF_MODE = {1: "p", 2: "c", 4: "d", 6: "b", 8: "-", 10: "l", 12: "s"}


def mode_text(mode: Column) -> Column:
    """A mode as ``-rw-r--r-- (0644)``: kind, rights with the set-id and sticky bits, then the rights as octal digits."""
    has = lambda bit: mode.bitwiseAND(bit) != 0
    kind = F.lit("?")
    for number, letter in KINDS_OF_MODE.items():
        kind = F.when(F.shiftright(mode, 12).bitwiseAND(15) == number, letter).otherwise(kind)
    parts = [kind]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        parts += [F.when(has(bit << shift), name).otherwise("-") for bit, name in ((4, "r"), (2, "w"))]
        runs = has(1 << shift)
        parts.append(
            F.when(has(special), F.when(runs, letter).otherwise(letter.upper())).otherwise(F.when(runs, "x").otherwise("-"))
        )
    octal = F.lpad(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8), 4, "0")
    return F.concat(*parts, F.lit(" ("), octal, F.lit(")"))


def partial_digest(content: Column, edge: int = 1 << 16) -> Column:
    """Of the size and both ends of the content, which don't overlap."""
    raw = content.cast("binary")
    size = F.length(raw)
    first = F.greatest(F.lit(edge), size - edge)
    tail = F.substring(raw, first + 1, F.greatest(size - first, F.lit(0)))
    return F.md5(F.concat(size.cast("string").cast("binary"), F.substring(raw, 1, edge), tail))
