import stat

import pytest
from pyspark.sql import functions as F

from twinsift.functions import paths


def column(spark, values, make):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, path string")
    return [x[0] for x in df.orderBy("i").select(make(F.col("path"))).collect()]


def test_copy_names(spark):
    names = ["/a/copy of x.txt", "/a/x (2).txt", "/a/x_1.txt", "/a/x_1", "/a/x.bak", "/a/photocopy.txt", "/a/x.txt", "/a/x_1b.txt", "/a/Écopy.txt", "/a/.copy"]
    assert column(spark, names, paths.looks_like_copy) == [True, True, True, True, True, False, False, False, False, True]


def test_disposable_folders_are_read_below_the_root(spark):
    files = ["/tmp/r/a/x", "/tmp/r/My-Backup/x", "/tmp/r/backups/x", "/tmp/x", "/tmp/r/OLD/b/x", "/tmp/r/cache"]
    assert column(spark, files, lambda p: paths.in_disposable_folder(p, "/tmp/r")) == [False, True, False, True, True, False]


def test_under_is_no_common_beginning(spark):
    assert column(spark, ["/a/b", "/a/b/c", "/a/bc"], lambda p: paths.is_under(p, "/a/b/")) == [True, True, False]


def test_suffix_and_stem(spark):
    names = ["/a/x.tar.gz", "/a/.bashrc", "/a/x", "/a/x.", "/a.b/c"]
    assert column(spark, names, paths.suffix) == [".gz", "", "", "", ""]
    assert column(spark, names, paths.stem) == ["x.tar", ".bashrc", "x", "x.", "c"]


@pytest.mark.parametrize(
    ("pattern", "gone"),
    [("node_modules", {1}), ("*.log", {2}), ("/r/abs", {3}), ("b/c", {4}), ("a?c", {6})],
)
def test_excludes(spark, pattern, gone):
    files = ["/r/keep.txt", "/r/x/node_modules/y", "/r/x.log", "/r/abs/z", "/r/a/b/c/q", "/r/xb/c", "/r/abc/f"]
    found = column(spark, files, lambda p: paths.is_excluded(p, [pattern]))
    assert {i for i, x in enumerate(found) if x} == gone


def test_excludes_end_where_the_name_ends(spark):
    assert column(spark, ["/r/x.log\n"], lambda p: paths.is_excluded(p, ["*.log"])) == [False]


def test_components_and_strings_sort_differently(spark):
    df = spark.createDataFrame([("/a-b",), ("/a/b",)], "path string")
    assert [x[0] for x in df.orderBy("path").collect()] == ["/a-b", "/a/b"]
    assert [x[0] for x in df.orderBy(paths.components(F.col("path"))).collect()] == ["/a/b", "/a-b"]


def test_human_sizes(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1023, 1024, 1536, 288000, 1 << 20, 5 << 40)], "n long")
    assert [x[0] for x in df.orderBy("n").select(paths.human_size(F.col("n"))).collect()] == [
        "0 B", "1023 B", "1.0 KiB", "1.5 KiB", "281.2 KiB", "1.0 MiB", "5.0 TiB",
    ]


def test_categories(spark):
    files = ["/a/x.JPG", "/a/x.mkv", "/a/x.md", "/a/x.zip", "/a/x.wav", "/a/x", "/a/x.heic", "/a/x.svg"]
    assert column(spark, files, paths.category) == ["Images", "Video", "Documents", "Archives", "Audio", "Other", "Images", "Images"]
    assert column(spark, files, paths.is_raster) == [True, False, False, False, False, False, False, False]
    assert column(spark, files, lambda p: paths.is_raster(p, codec=True))[6]


def test_modes_as_text(spark):
    modes = list(range(0, 1 << 16, 7)) + [0o100644, 0o104755, 0o042755, 0o041777, 0o120777]
    rows = spark.createDataFrame([(x,) for x in modes], "mode int").select("mode", paths.mode_text(F.col("mode"))).collect()
    known = {1, 2, 4, 6, 8, 10, 12}
    assert all(shown[1:] == f"{stat.filemode(mode)[1:]} ({mode & 0o7777:04o})" for mode, shown in rows)
    assert all(shown[0] == (stat.filemode(mode)[0] if mode >> 12 in known else "?") for mode, shown in rows)
