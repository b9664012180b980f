import base64
import io
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift.functions import images
from twinsift.sources import images as image_source
from twinsift.sources import perceptual, settings, store, tree


@pytest.fixture
def make(tmp_path):
    def build(spec):
        for name, content in spec.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
        return str(tmp_path)

    return build


def listed(spark, root, **options):
    found, skipped = tree.scan(spark, root, tree.TreeOptions(**options))
    return {os.path.relpath(x["path"], root) for x in found.collect()}, {x["path"]: x["reason"] for x in skipped.collect()}


def test_tree(spark, make):
    root = make({"a.txt": b"x", ".hid": b"x", ".d/in": b"123456", "e": b"", ".git/c": b"x", "s/node_modules/q": b"x", "s/deep/f": b"12", "l.log": b"x"})
    os.symlink(root, os.path.join(root, "s/loop"))
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link"))
    assert listed(spark, root)[0] == {"a.txt", ".hid", ".d/in", "s/deep/f", "l.log"}
    assert listed(spark, root, include_hidden=False, min_size=0)[0] == {"a.txt", "e", "s/deep/f", "l.log"}
    assert listed(spark, root, exclude=("*.log", "deep/f", root + "/.d"))[0] == {"a.txt", ".hid", ".git/c", "s/node_modules/q"}
    followed = listed(spark, root, follow_symlinks=True)[0]
    assert "link" in followed and len(followed) < 30
    assert listed(spark, root + "/gone")[1] == {root + "/gone": "vanished"}
    assert listed(spark, root + "/a.txt")[1] == {root + "/a.txt": "not a directory"}


@pytest.mark.parametrize("eager, large", [(20_000, 20_000), (1, 20_000), (5, 3), (0, 0)])
def test_frontier_equals_a_plain_walk(spark, make, eager, large):
    spec = {f"d{i % 4}/e{i % 3}/f{i}": b"x" * (i % 3) for i in range(60)} | {"wide/" + str(i): b"1" for i in range(40)} | {".git/z": b"1", "a/.b/c": b"22"}
    root = make(spec)
    os.makedirs(os.path.join(root, "empty/one"))
    os.symlink("nowhere", os.path.join(root, "dangling"))
    rows = tree.entries(spark, root, tree.TreeOptions(min_size=0, exclude=()), True, eager, large).collect()
    plain = {os.path.join(top, x) for top, folders, files in os.walk(root) for x in (*folders, *files)}
    assert sorted(x["path"] for x in rows) == sorted(plain)
    assert all(x["size"] == os.lstat(x["path"]).st_size and x["is_dir"] == (os.path.isdir(x["path"]) and not os.path.islink(x["path"])) for x in rows)
    files = tree.entries(spark, root, tree.TreeOptions(min_size=1), False, eager, large).where("not is_dir").collect()
    wanted = sorted(x for x in plain if os.path.isfile(x) and os.path.getsize(x) and "/.git/" not in x)
    assert sorted(x["path"] for x in files) == wanted


def test_a_folder_that_two_links_reach_is_entered_once(spark, make):
    root = make({"real/x": b"1", "real/in/y": b"22", "a/k": b"1", "b/k": b"1"})
    os.symlink(os.path.join(root, "real/in"), os.path.join(root, "a/one"))
    os.symlink(os.path.join(root, "real/in"), os.path.join(root, "b/two"))
    os.symlink(root, os.path.join(root, "a/loop"))
    os.symlink(os.path.join(root, "b"), os.path.join(root, "real/in/deep"))
    found = listed(spark, root, follow_symlinks=True)[0]
    assert sum(x.endswith("/y") for x in found) == 1 and sum(x.endswith("k") for x in found) == 2 and len(found) == 4


def test_a_folder_that_cannot_be_listed_is_skipped(spark, make, monkeypatch):
    root = make({"ok/x": b"1", "shut/y": b"1"})
    below = tree.Look.below

    def refuse(self, folder):
        return ([], self.failed(folder, "permission denied")) if folder.endswith("shut") else below(self, folder)

    monkeypatch.setattr(tree.Look, "below", refuse)
    rows = [tuple(x) for x in pa.Table.from_batches(tree._grown(tree.Look(tree.TreeOptions(), os.stat(root).st_dev), 99, 99)(iter([pa.RecordBatch.from_pydict({"path": [root], "todo": [tree.FOLDER]})]))).select(["path", "error"]).to_pandas().values.tolist()]
    assert (os.path.join(root, "shut"), "permission denied") in rows and (os.path.join(root, "ok/x"), None) in rows


def test_staged_digests(spark, make):
    edge = 1 << 16
    ends = b"h" * edge, b"t" * edge
    root = make({"a": ends[0] + b"x" * 9 + ends[1], "b": ends[0] + b"x" * 9 + ends[1], "c": ends[0] + b"y" * 9 + ends[1], "d": b"1", "e": b"2", "f": b"333"})
    found, _ = tree.scan(spark, root)
    done, failed, _ = tree.with_digests(found)
    by = {os.path.basename(x["path"]): x["full"] for x in done.collect()}
    assert set(by) == {"a", "b", "c"} and by["a"] == by["b"] != by["c"] and failed.count() == 0


def test_settings(tmp_path):
    path = str(tmp_path / "x" / "s.toml")
    assert settings.load(path) == (settings.Settings(), [])
    own = settings.Settings(workers=3, exclude=('a"b', "c\\d"), default_delete_mode="permanent", paranoid=True)
    settings.save(own, path)
    assert settings.load(path) == (own, [])
    for line, key in (("workers = 65", "workers"), ("workers = true", "workers"), ("min_size = -1", "min_size"), ('default_delete_mode = "x"', "default_delete_mode"), ("exclude = [1]", "exclude"), ("similarity_threshold = 17", "similarity_threshold")):
        (tmp_path / "bad").write_text(line)
        with pytest.raises(ValueError, match=key):
            settings.load(str(tmp_path / "bad"))
    (tmp_path / "odd").write_text("colour = 1")
    assert settings.load(str(tmp_path / "odd"))[1] == ["unknown setting: colour"]


def photo(seed, height=240, width=320):
    """A smooth random picture."""
    rng = np.random.default_rng(seed)
    return images.resized(rng.integers(0, 256, (9, 12)).astype(np.uint8), height, width)


def png(pixels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def distance(a, b):
    return max(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


def test_hashes_of_resized_turned_and_other_images():
    a, b = images.working_copy(photo(1)), images.working_copy(photo(1, 480, 640))
    assert distance(images.hashes(a)[0], images.hashes(b)[0]) <= 4
    turned = images.hashes(images.working_copy(np.ascontiguousarray(np.rot90(photo(1)))))[0]
    assert min(distance(v, turned) for v in images.hashes(a)) <= 8
    far = [distance(images.hashes(a)[0], images.hashes(images.working_copy(photo(s)))[0]) for s in range(2, 8)]
    assert min(far) > 12
    assert images.hashes(np.full((64, 64), 9, np.uint8)) == []


def test_borders_go():
    inner = photo(3, 100, 160)
    framed = np.pad(inner, ((40, 40), (0, 0)), constant_values=0)
    framed[[0, -1]] = 0
    assert abs(images.trimmed(framed).shape[0] - 100) <= 4


def plain_ssim(a, b, side=images.SSIM_SIDE):
    scores = []
    for r in range(a.shape[0] - side + 1):
        for c in range(a.shape[1] - side + 1):
            x, y = (v[r : r + side, c : c + side].astype(float).ravel() for v in (a, b))
            both = np.cov(x, y)
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            scores.append((2 * x.mean() * y.mean() + c1) * (2 * both[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (both[0, 0] + both[1, 1] + c2)))
    return np.mean(scores)


def test_ssim_and_shifts():
    a = images.working_copy(photo(4))
    far = images.working_copy(photo(5))
    assert images.ssims(np.stack([a, a]), np.stack([a, far])) == pytest.approx([1, plain_ssim(a, far)])
    wide = images.resized(photo(4), 80, 80)
    x = np.stack([wide[:64, :64]] * 2 + [a])
    y = np.stack([wide[5:69, 3:67], wide[:64, :64], far])
    assert images.likely_shifts(x, y)[:2, 0].tolist() == [[5, 3], [0, 0]]
    scores = images.aligned_ssims(x, y)
    assert scores[0] > 0.95 > images.ssims(x, y)[0] and scores[1] == pytest.approx(1) and scores[2] < 0.6
    one_by_one = [images.aligned_ssims(x[k : k + 1], y[k : k + 1])[0] for k in range(3)]
    assert scores.tolist() == pytest.approx(one_by_one)


def test_sketches_are_means_of_blocks():
    copy = np.arange(64 * 64).reshape(64, 64).astype(np.uint8)
    assert images.sketch(copy)[3, 5] == round(copy[6:8, 10:12].mean())


def test_exif():
    stamp = b"2020:01:02 03:04:05\0"
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 274, 3, 1, 6) + struct.pack("<HHII", 34665, 4, 1, 38) + b"\0\0\0\0"
    tiff += struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, len(stamp), 56) + b"\0\0\0\0" + stamp
    raw = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    tags = images.exif(io.BytesIO(raw))
    assert tags[274] == 6 and images.capture_seconds(tags) == 1577934245 and images.display_date(tags) == "2020:01:02 03:04:05"
    far = raw[:2] + b"".join(b"\xff\xe2" + struct.pack(">H", 65535) + b"\0" * 65533 for _ in range(9)) + raw[2:]
    assert images.exif(io.BytesIO(far)) == tags
    assert images.exif(io.BytesIO(b"\x89PNG")) == images.exif(io.BytesIO(raw[:9])) == images.exif(io.BytesIO(b"")) == {} and images.capture_seconds({36867: "0000:00:00 00:00:00"}) is None


def test_similar_images_end_to_end(spark, make):
    from twinsift.operators import similar

    root = make({"big.png": png(photo(1, 480, 640)), "small.png": png(photo(1)), "other.png": png(photo(9)), "bad.png": b"nothing"})
    names = [(os.path.join(root, x),) for x in ("big.png", "small.png", "other.png", "bad.png")]
    rows = image_source.hashed(spark.createDataFrame(names, "path string"))
    assert [os.path.basename(x["path"]) for x in rows.where("error is not null").collect()] == ["bad.png"]
    good = rows.where("size(variants) > 0").withColumn("idx", F.element_at(F.map_from_arrays(F.array(*[F.lit(os.path.join(root, x)) for x in ("big.png", "small.png", "other.png")]), F.array(F.lit(0), F.lit(1), F.lit(2))), F.col("path")).cast("long"))
    found = similar.hamming_candidates(good, 12).withColumn("by_time", F.lit(False))
    assert [(x["i"], x["j"]) for x in image_source.verified(found, good, 8).collect()] == [(0, 1)]
    assert [(x["i"], x["j"]) for x in image_source.verified(found.withColumn("dp", F.lit(20)), good, 8).collect()] == [(0, 1)]


def test_versions_of_a_table(spark, tmp_path):
    folder, shape = str(tmp_path / "deep" / "table"), "x long"
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], shape)
    assert store.read(spark, folder, shape) is None and store.versions(spark, folder) == []
    store.publish(rows(1, 2), folder)
    held = store.read(spark, folder, shape)
    store.publish(held.unionByName(rows(3)), folder)  # derived from itself
    assert sorted(x[0] for x in store.read(spark, folder, shape).collect()) == [1, 2, 3]
    assert held.count() == 2  # the former version still stands for its readers
    os.makedirs(tmp_path / "deep" / "table" / "v99999999999999999999-crashed")
    assert store.read(spark, folder, shape).count() == 3
    store.publish(rows(), folder)
    assert store.read(spark, folder, shape).count() == 0 and len(store.versions(spark, folder)) == 2


def test_text_form_of_hashes(spark):
    variants = ";".join(f"{k:016x}{(1 << 64) - 1 - k:016x}" for k in range(8))
    sketch = base64.b64encode(bytes(1024)).decode()
    good = [f"640,480;{variants}", f"640,480,-5;{variants}|{sketch}", "9,8;"]
    bad = [
        "", "640;", f"640,480,1,2;{variants}", f"640,480;{variants[:-33]}", f"640,480;{variants[:-1]}", f"640,480;{variants}|{sketch[:-4]}",
        f"640,480;{variants}|{sketch[:-2]}!=", f"x,480;{variants}", variants, f"640,480;{variants}|{sketch}|",
    ]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "text string").withColumn("v", perceptual.from_text(F.col("text")))
    back = perceptual.to_text(*[F.col(f"v.{x}") for x in ("width", "height", "taken", "variants", "sketch")])
    got = {x["text"]: (x["v"], x["back"]) for x in rows.withColumn("back", back).collect()}
    assert all(got[x][1] == x for x in good) and all(got[x][0] is None for x in [*bad, None])
    assert got[good[1]][0]["variants"][3] == (3, -4) and got[good[1]][0]["taken"] == -5


def test_headers_tell_what_is_not_decoded(spark, make):
    good = png(photo(1))
    bomb = good[:16] + struct.pack(">II", 20_000, 20_000) + good[24:]
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 70) + b"x" * 68 + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 480, 640)
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 30, -20)
    shapes = {good: (320, 240), bomb: (20_000, 20_000), jpeg: (640, 480), bmp: (30, 20), b"GIF89a\x05\0\x07\0": (5, 7)}
    assert all(images.dimensions(io.BytesIO(k)) == v for k, v in shapes.items())
    assert all(images.dimensions(io.BytesIO(x)) is None for x in (b"", b"II*\0", jpeg[:60], b"RIFF....WEBP", good[:18]))
    root = make({"good.png": good, "bomb.png": bomb, "cut.png": good[:60], "no.webp": b"RIFF....WEBPVP8 ", "empty.jpg": b""})
    names = spark.createDataFrame([(os.path.join(root, x),) for x in (*os.listdir(root), "gone.gif")], "path string")
    why = {os.path.basename(x["path"]): x["error"] for x in image_source.hashed(names).collect()}
    assert why == {
        "good.png": None, "bomb.png": image_source.TOO_LARGE, "cut.png": image_source.CORRUPT, "no.webp": image_source.UNKNOWN,
        "empty.jpg": image_source.UNKNOWN, "gone.gif": "No such file or directory",
    }
