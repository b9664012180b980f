import json
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from test_sources import make, photo, png  # noqa: F401

from twinsift import cli, scan
from twinsift.functions import paths
from twinsift.job import Job
from twinsift.operators import exact, stages
from twinsift.operators.stages import GroupingStage
from twinsift.sources import images, perceptual, tree


def test_exact_and_similar_scan(spark, make):  # noqa: F811
    root = make({
        "big.png": png(photo(1, 480, 640)), "tmp/small.png": png(photo(1)), "copy/small.png": png(photo(1)),
        "other.png": png(photo(9)), "e": b"", "k/a.txt": b"same", "a.txt": b"same",
    })
    os.link(os.path.join(root, "a.txt"), os.path.join(root, "z.txt"))
    found = scan.exact_scan(spark, root, protected=[os.path.join(root, "k")])
    verdicts = {os.path.relpath(x["path"], root): (x["verdict"], x["links"]) for x in found.members.collect()}
    assert verdicts["k/a.txt"][0] == "keep" and verdicts["a.txt"][0] == "delete"
    assert [os.path.basename(x) for x in verdicts["a.txt"][1]] == ["z.txt"]
    assert found.hardlink_sets.count() == 1 and found.groups.count() == 2
    pictures = {os.path.relpath(x["path"], root): x for x in scan.similar_scan(spark, found).collect()}
    assert len(pictures) == 2 and pictures["big.png"]["verdict"] == "keep"
    assert pictures["big.png"]["reason"] == "Kept: highest resolution"
    other = next(x for k, x in pictures.items() if k != "big.png")
    assert other["verdict"] == "delete" and len(other["aliases"]) == 1 and len(other["group_id"]) == 16


def test_hidden_scan(spark, make):  # noqa: F811
    root = make({".x": b"1", "a/b~": b"22", "a/ok": b"3", ".d/e": b"4444"})
    items, _ = scan.hidden_scan(spark, root, "/home/nobody")
    assert {(os.path.relpath(x["path"], root), x["size"], x["preselect"]) for x in items.collect()} == {(".x", 1, False), ("a/b~", 2, True), (".d", 4, False)}


def brute_hidden(root):
    """(path, is_dir, size) of the topmost matching entries."""
    from twinsift.operators import hidden

    def inside(folder):
        return sum(inside(e.path) if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size for e in os.scandir(folder))

    def matches(name, folder):
        temporary = not folder and (name in hidden.OS_METADATA or name.endswith((".swp", ".swo", ".tmp")))
        return name.startswith((".", "~")) or name.endswith("~") or temporary

    found, waiting = set(), [root]
    while waiting:
        for e in os.scandir(waiting.pop()):
            folder = e.is_dir(follow_symlinks=False)
            if matches(e.name, folder):
                found.add((e.path, folder, inside(e.path) if folder else e.stat(follow_symlinks=False).st_size))
            elif folder:
                waiting.append(e.path)
    return found


def test_hidden_items_of_every_kind(spark, make):  # noqa: F811
    root = make({".x": b"1", "a/b~": b"22", "a/ok": b"3", ".d/e": b"4444", ".d/.in/f": b"1", "q.tmp/r": b"1", "w.tmp": b"55", "z/Thumbs.db": b"1", "~$a.docx": b""})
    for folder in (".empty", "a/.deep/er", "plain", "old~"):
        os.makedirs(os.path.join(root, folder))
    os.symlink("nowhere at all", os.path.join(root, "a/.dangling"))
    os.symlink(os.path.join(root, "a"), os.path.join(root, ".d/.link"))
    os.symlink(root, os.path.join(root, "plain/loop.swp"))
    items, skipped = scan.hidden_scan(spark, root, "/home/nobody")
    got = {(x["path"], x["is_dir"], x["size"]) for x in items.collect()}
    assert got == brute_hidden(root) and items.count() == len(got) and skipped.count() == 0
    assert (os.path.join(root, ".empty"), True, 0) in got and (os.path.join(root, "a/.dangling"), False, 14) in got


def test_what_fails_inside_an_item_is_not_skipped(spark):
    from twinsift.operators import hidden

    rows = spark.createDataFrame([("/r/.d/x", "permission denied"), ("/r/a/b", "vanished"), ("/r/~q", "vanished"), ("/r", "vanished")], "path string, reason string")
    assert sorted(x["path"] for x in hidden.outside(rows, "/r").collect()) == ["/r", "/r/a/b"]


def test_command_line(spark, make, capsys, monkeypatch, tmp_path_factory):  # noqa: F811
    home = tmp_path_factory.mktemp("home")
    for kind in ("CONFIG", "CACHE"):
        monkeypatch.setenv(f"XDG_{kind}_HOME", str(home / kind))
    os.makedirs(home / "CONFIG" / "twinsift")
    (home / "CONFIG" / "twinsift" / "settings.toml").write_text("min_size = 0\ncolour = 1\n")
    root = make({"a": b"same", "b": b"same", "c": b"else", "e": b"", "x.png": b"nothing", "_y.PNG": png(photo(1, 480, 640)), ".z.Png": png(photo(1))})
    os.link(os.path.join(root, "a"), os.path.join(root, "l"))
    assert cli.main(["scan", root, "--json", "--similar", "--paranoid"]) == 0
    out = capsys.readouterr()
    found, base = json.loads(out.out), lambda xs: [os.path.basename(x) for x in xs]
    assert "unknown setting: colour" in out.err and found["root"] == root and found["files_scanned"] == 8 and not found["cancelled"]
    group = found["groups"][0]
    assert len(found["groups"]) == 1 and base(f["path"] for f in group["files"]) == ["a", "b"] and base(group["hardlinked"]) == ["l"]
    assert group["files"][0]["verdict"] == "keep" and found["reclaimable"] == group["reclaimable"] == 4
    assert base(found["empty_files"]) == ["e"] and [base(x) for x in found["hardlink_sets"]] == [["a", "l"]]
    assert [(os.path.basename(x["path"]), x["reason"]) for x in found["skipped"]] == [("x.png", "unsupported or unrecognised image format")]
    pictures = found["similar_groups"]
    assert len(pictures) == 1 and base(x["path"] for x in pictures[0]["members"]) == ["_y.PNG", ".z.Png"]
    assert pictures[0]["members"][0]["width"] == 640 and pictures[0]["reclaimable"] == pictures[0]["members"][1]["size"]
    assert cli.main(["scan", root]) == 0
    text = capsys.readouterr().out
    assert "8 files scanned, 1 duplicate groups, 4 B reclaimable" in text and "hard link" in text and "empty file" in text
    assert cli.main(["hidden", root, "--json"]) == 0
    items = json.loads(capsys.readouterr().out)
    assert [x["type"] for x in items["items"]] == ["file"] and items["reclaimable_preselected"] == 0 and items["skipped"] == []
    assert cli.main(["cache", "clear"]) == 0 and "cleared 3 cached hashes" in capsys.readouterr().out
    assert cli.main(["scan", root, "--threshold", "99"]) == 2 and cli.main(["scan", root + "/nowhere"]) == 2 and cli.main([]) == 0


def test_second_scan_reads_nothing(spark, make, monkeypatch, tmp_path_factory):  # noqa: F811
    root, cache = make({"a": b"same", "b": b"same", "c": b"else", "d": b"other size"}), str(tmp_path_factory.mktemp("home") / "cache")
    first = scan.exact_scan(spark, root, cache=cache)
    whole, read = tree._read, []

    def counted(files, column, edge):
        read.append((column, files.count()))
        return whole(files, column, edge)

    monkeypatch.setattr(tree, "_read", counted)
    again = scan.exact_scan(spark, root, cache=cache)
    assert read == [("partial", 0), ("full", 0)]
    assert sorted(map(str, again.members.collect())) == sorted(map(str, first.members.collect()))
    with open(os.path.join(root, "b"), "wb") as file:
        file.write(b"elsf")
    read.clear()
    assert scan.exact_scan(spark, root, cache=cache).members.count() == 0 and read == [("partial", 1), ("full", 0)]


def test_second_similar_scan_decodes_nothing(spark, make, monkeypatch, tmp_path_factory):  # noqa: F811
    root = make({"big.png": png(photo(1, 480, 640)), "small.png": png(photo(1)), "other.png": png(photo(9)), "bad.png": b"nothing"})
    cache, whole, decoded = str(tmp_path_factory.mktemp("home") / "cache"), images.hashed, []

    def counted(files):
        decoded.append(sorted(os.path.basename(x["path"]) for x in files.select("path").collect()))
        return whole(files)

    def pictures():
        found = scan.exact_scan(spark, root, cache=cache)
        rows = scan.similar_scan(spark, found, cache=cache).collect()
        assert found.warnings == [] and [os.path.basename(x["path"]) for x in found.skipped.collect()] == ["bad.png"]
        return sorted(map(str, rows))

    monkeypatch.setattr(images, "hashed", counted)
    first = pictures()
    assert len(first) == 2 and pictures() == first
    assert decoded == [["bad.png", "big.png", "other.png", "small.png"], ["bad.png"]]
    os.utime(os.path.join(root, "small.png"), ns=(1, 10**18))
    decoded.clear()
    assert len(pictures()) == 2 and decoded == [["bad.png", "small.png"]]
    decoded.clear()
    monkeypatch.setattr(perceptual.hits, "__defaults__", ("another algorithm",))
    monkeypatch.setattr(perceptual.renewed, "__defaults__", ("another algorithm",))
    assert len(pictures()) == 2 and len(decoded[0]) == 4
    assert len(pictures()) == 2 and decoded[1] == ["bad.png"]


def test_paranoid_tells_equal_digests_apart(spark, make):  # noqa: F811
    root = make({"a": b"one", "b": b"one", "c": b"two", "d": b"two"})
    rows = tree.scan(spark, root)[0].withColumns({"partial": F.lit("p"), "full": F.lit("f"), "links": F.array().cast("array<string>")})
    told, failed = tree.told_apart(rows)
    groups = exact.grouped(told, "twin").groupBy("group_id").agg(F.count("*").alias("n")).collect()
    assert [x["n"] for x in groups] == [2, 2] and failed.count() == 0


def test_progress_agrees_with_the_result(spark, make):  # noqa: F811
    root = make({"a": b"same", "b": b"same", "c": b"else", "d": b"longer", "e": b"longer", "f": b"1", "g": b""})
    seen = []
    found = scan.exact_scan(spark, root, tree.TreeOptions(min_size=0), job=Job(spark, seen.append))
    assert [(x.stage, x.rows, x.size) for x in seen] == [
        ("listed", 7, 25), ("partial", 5, 24), ("full", 4, 20), ("hashed", 4, 20), ("members", 4, 20),
    ]
    assert found.n_files == found.files.count() == 7 and found.members.count() == seen[-1].rows and not found.cancelled


def test_cancel_from_another_thread(spark, make):  # noqa: F811
    def sleep(batches):
        for batch in batches:
            time.sleep(40)
            yield batch

    def slow(rows):
        fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
        return rows.mapInPandas(sleep, fields).withColumns({"slow": F.lit(1), "error": F.lit(None).cast("string")})

    root = make({"a": b"same", "b": b"same", "c": b"else"})
    hashed = threading.Event()
    job = Job(spark, lambda x: hashed.set() if x.stage == "full" else None)
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(scan.exact_scan, spark, root, job=job, more=[GroupingStage("slow", slow)])
        assert hashed.wait(120)
        time.sleep(3)  # the slow stage runs
        began = time.monotonic()
        job.cancel()
        found = running.result(timeout=30)
    assert time.monotonic() - began < 10
    assert found.cancelled and found.n_files == 3 and found.members.count() == found.groups.count() == 0
    assert spark.range(5).count() == 5  # nobody else is stopped
    again = scan.exact_scan(spark, root, job=job)
    assert again.cancelled  # a handle is used once


def test_an_added_stage_splits_groups(spark, make):  # noqa: F811
    root = make({"a.txt": b"same", "b.txt": b"same", "c.dat": b"same", "d.dat": b"same", "e.bin": b"same"})
    suffix = GroupingStage("suffix", lambda rows: rows.withColumns({"suffix": paths.suffix(F.col("path")), "error": F.lit(None).cast("string")}))
    plain, split = scan.exact_scan(spark, root), scan.exact_scan(spark, root, more=[suffix])
    names = lambda found: sorted(sorted(os.path.basename(p) for p in x[1]) for x in found.members.groupBy("group_id").agg(F.collect_list("path")).collect())
    assert names(plain) == [["a.txt", "b.txt", "c.dat", "d.dat", "e.bin"]] and names(split) == [["a.txt", "b.txt"], ["c.dat", "d.dat"]]


def test_stages_that_cost_nothing_share_a_join(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 2), ("d", 2, 2)], "path string, size long, owner long")
    joined, whole = [], stages.shared_keys

    def counted(rows, keys):
        joined.append(list(keys))
        return whole(rows, keys)

    compute = lambda r: r.withColumns({"costly": F.lit(0), "error": F.when(F.col("path") == "b", "gone")})
    mine = [GroupingStage("size"), GroupingStage("owner"), GroupingStage("costly", compute)]
    stages.shared_keys, found = counted, None
    try:
        found = stages.refine(rows, mine, lambda r, _: r)
    finally:
        stages.shared_keys = whole
    assert joined == [["size", "owner"]] and [x["path"] for x in found.rows.collect()] == ["a"]
    assert [tuple(x) for x in found.skipped.collect()] == [("b", "gone")]
