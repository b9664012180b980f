import json
import random

import pytest
from pyspark.sql import functions as F

from twinsift.operators import exact, hidden, keep, similar, view
from twinsift.plans import actions
from twinsift.sources import report, snapshot

FILE = "path string, size long, mtime_ns long, inode long, device long, content string"
MEMBER = "group_id string, hash string, path string, size long, mtime_ns long, inode long, device long"


def files(spark, *rows):
    return spark.createDataFrame([(p, 4 if c is None else len(c), i, n, 1, c) for i, (p, n, c) in enumerate(rows)], FILE)


def members(spark, *rows):
    return spark.createDataFrame([(g, "h" * 20, p, 10, m, i, 1) for i, (g, p, m) in enumerate(rows)], MEMBER)


def verdicts(found):
    return {x["path"]: (x["verdict"], x["reason"]) for x in found.collect()}


def test_groups_links_and_empties(spark):
    head, tail = "h" * 65536, "t" * 65536
    df = files(
        spark, ("/a", 1, "same"), ("/b", 1, "same"), ("/c", 2, "same"), ("/d", 3, "diff"), ("/e", 4, ""), ("/f", 5, ""),
        ("/g", 6, head + "x" * 9000 + tail), ("/h", 7, head + "x" * 9000 + tail), ("/i", 8, head + "y" * 9000 + tail), ("/j", 9, None),
    )
    found = exact.group_files(exact.digested(df))
    sets = {frozenset(x["p"]) for x in found.groupBy("group_id").agg(F.collect_list("path").alias("p")).collect()}
    assert sets == {frozenset({"/a", "/c"}), frozenset({"/g", "/h"})}
    assert found.where("path = '/a'").first()["links"] == ["/b"]
    assert [x["paths"] for x in exact.hardlink_sets(df).collect()] == [["/a", "/b"]]
    assert {x["path"] for x in exact.empty_files(df).collect()} == {"/e", "/f"}
    assert exact.totals(df, found).first()["reclaimable"] == 4 + 65536 * 2 + 9000


def test_only_links_are_no_group(spark):
    df = files(spark, ("/a", 1, "x"), ("/b", 1, "x"))
    assert exact.group_files(exact.digested(df)).count() == 0 and exact.hardlink_sets(df).count() == 1


def test_first_rule_decides_and_later_ones_never_run(spark):
    """An early rule leaves two files; the older one and the shorter path lose to the alphabet."""
    df = members(spark, ("g", "/r/tmp/a", 0), ("g", "/r/x/b/long/a (1)", 9), ("g", "/r/x/c", 1))
    assert verdicts(keep.recommend(df, (), "/r")) == {
        "/r/tmp/a": ("delete", "Duplicate of /r/x/b/long/a (1)"),
        "/r/x/b/long/a (1)": ("keep", "Kept: not in a disposable-looking folder"),
        "/r/x/c": ("delete", "Duplicate of /r/x/b/long/a (1)"),
    }


def test_keep_rule_against_the_sequential_rule(spark):
    random.seed(7)
    rows = []
    for g in range(150):
        for _ in range(random.randint(2, 6)):
            folder = random.choice(["/r", "/r/tmp", "/r/old/x", "/r/k", "/r/a/b"])
            name = random.choice(["x", "x_1", "x (2)", "copy x", "y", "zz"]) + str(random.randint(0, 99)) * random.randint(0, 1)
            rows.append((str(g), f"{folder}/{name}{len(rows)}q" if random.random() < 0.5 else f"{folder}/{len(rows)}{name}", random.randint(0, 2)))
    df = members(spark, *rows).withColumns({
        "disposable": keep._rules((), "/r")[1], "copied": keep._rules((), "/r")[2],
    }).collect()
    got = {x["group_id"]: x["winner"] for x in keep.winners(members(spark, *rows), ("/r/k",), "/r").collect()}
    for g, winner in got.items():
        left = [x for x in df if x["group_id"] == g]
        rules = [
            lambda x: not x["path"].startswith("/r/k/"), lambda x: x["disposable"], lambda x: x["copied"],
            lambda x: x["mtime_ns"], lambda x: (x["path"].count("/"), len(x["path"])),
        ]
        for rule in rules:
            best = [x for x in left if rule(x) == min(map(rule, left))]
            if len(best) < len(left):
                left = best
                break
        assert winner == min(x["path"] for x in left)


def test_protection_and_bulk_rules(spark):
    df = members(spark, ("g", "/r/k/a", 5), ("g", "/r/k/b", 6), ("g", "/r/c", 9), ("h", "/r/d", 1), ("h", "/r/e", 1))
    found = verdicts(keep.recommend(df, ("/r/k",), "/r"))
    assert [found[p][0] for p in ("/r/k/a", "/r/k/b", "/r/c")] == ["keep", "keep", "delete"]
    assert found["/r/c"][1] == "Duplicate of /r/k/a" and found["/r/d"][1] == "Kept: alphabetical tie-break"
    newest = verdicts(keep.keep_newest(df, ("/r/k",), "/r"))
    assert newest["/r/c"] == ("keep", "Kept: newest modification time") and newest["/r/k/a"][0] == "keep"
    inside = verdicts(keep.keep_in_folder(df, "/r/k", (), "/r"))
    assert inside["/r/k/a"] == ("keep", "Kept: in folder /r/k") and inside["/r/d"][0] == "keep"
    assert {x["path"] for x in keep.suggested_deletions(keep.recommend(df, ("/r/k",))).collect()} == {"/r/c", "/r/e"}


def test_similar_ranking_goes_through_all_rules(spark):
    rows = [("g", "/r/a_1.jpg", 9, 5, 0), ("g", "/r/tmp/b.jpg", 9, 5, 1), ("g", "/r/c.jpg", 4, 99, 0)]
    df = spark.createDataFrame(rows, "group_id string, path string, pixels long, size long, mtime_ns long")
    found = keep.recommend_similar(df, (), "/r").orderBy("rank").collect()
    assert [x["path"] for x in found] == ["/r/tmp/b.jpg", "/r/a_1.jpg", "/r/c.jpg"]
    assert found[0]["reason"] == "Kept: best-ranked copy" and found[1]["reason"] == "Similar to /r/tmp/b.jpg"


def test_hidden_items(spark):
    rows = [("/h/.config/a", 1), ("/h/.config/sub/.x", 2), ("/h/p/~$d.docx", 3), ("/h/p/x~", 4), ("/h/p/.DS_Store", 5), ("/h/p/y.swp", 6), ("/h/p/z.swp", 7), ("/h/p/n.tmp", 8), ("/h/p/ok", 9), ("/h/p/d.tmp/in", 10)]
    held = spark.createDataFrame([("/h/p/z.swp",)], "path string")
    found = {x["path"]: x for x in hidden.items(spark.createDataFrame(rows, "path string, size long"), "/h", "/h", held).collect()}
    assert set(found) == {"/h/.config", "/h/p/~$d.docx", "/h/p/x~", "/h/p/.DS_Store", "/h/p/y.swp", "/h/p/z.swp", "/h/p/n.tmp"}
    assert found["/h/.config"]["size"] == 3 and found["/h/.config"]["protected"] and found["/h/.config"]["home_dot"]
    assert {p for p, x in found.items() if x["preselect"]} == {"/h/p/~$d.docx", "/h/p/x~", "/h/p/.DS_Store", "/h/p/y.swp"}


def test_view(spark):
    df = members(spark, ("g", "/r/A.jpg", 1), ("g", "/r/b.txt", 1), ("h", "/r/c.pdf", 1), ("h", "/r/d.pdf", 1)).withColumn("links", F.array().cast("array<string>"))
    assert {x["path"] for x in view.by_type(df, "Images").collect()} == {"/r/A.jpg", "/r/b.txt"}
    assert view.by_text(df, " a.JP ").count() == 2 and view.by_text(df, " ").count() == 4
    assert [x["group_id"] for x in view.ordered(df, "name").collect()] == ["g", "h"]
    assert [tuple(x) for x in view.representatives(df).collect()] == [("g", "/r/A.jpg")]


def brute_leaders(order, edges):
    near = {}
    for i, j in edges:
        near.setdefault(i, set()).add(j), near.setdefault(j, set()).add(i)
    leader = {}
    for node in order:
        known = [x for x in order if x in near.get(node, ()) and leader.get(x) == x]
        leader[node] = known[0] if known else node
    return leader


def test_leader_clusters_against_the_sequential_rule(spark):
    random.seed(1)
    order, edges, base = [], [], 0
    for _ in range(60):
        n = random.randint(2, 14)
        own = list(range(base, base + n))
        random.shuffle(own)
        order += own
        edges += [(i, j) for i in range(base, base + n) for j in range(i + 1, base + n) if random.random() < 0.3]
        base += n
    ranked = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "idx long, rank int")
    got = {x["idx"]: x["leader"] for x in similar.leader_clusters(ranked, spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == brute_leaders(order, edges)


@pytest.mark.parametrize("small", [500_000, 12])
def test_chains_end_in_few_rounds(spark, monkeypatch, small):
    n, seen = (3000, []) if small > 12 else (40, [])
    edges = [(i, i + 1) for i in range(n)] + [(n + 10 + i, n + 11 + i) for i in range(5)]
    order = [*range(n + 1), *range(n + 10, n + 16)]
    ranked = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "idx long, rank int")
    whole = similar.components
    monkeypatch.setattr(similar, "components", lambda e: seen.append(1) or whole(e))
    got = {x["idx"]: x["leader"] for x in similar.leader_clusters(ranked, spark.createDataFrame(edges, "i long, j long"), small=small).collect()}
    assert got == brute_leaders(order, edges) and (len(seen) == 1 or small == 12)


def test_a_burst_with_one_time_is_many_tasks(spark):
    n = 500
    df = spark.createDataFrame([(k, 100 if k < 400 else 100 + k, k % 16, k % 8) for k in range(n)], "idx long, taken long, phash long, dhash long")
    shots = sorted((100 if k < 400 else 100 + k, k) for k in range(n))
    brute = {tuple(sorted((shots[a][1], shots[b][1]))) for a in range(n) for b in range(a + 1, min(n, a + 7)) if shots[b][0] - shots[a][0] <= 60}
    for stretch in (4, 50, 4096):
        found = similar.scene_candidates(df, stretch=stretch)
        assert {(x["i"], x["j"]) for x in found.collect()} == brute and found.count() == len(brute)


def test_hamming_against_brute_force(spark):
    random.seed(2)
    pool = [random.getrandbits(63) for _ in range(4)]
    noisy = lambda: random.choice(pool) ^ sum(1 << b for b in random.sample(range(63), random.randint(0, 8)))
    rows = [(i, [{"p": noisy(), "d": noisy()} for _ in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, variants array<struct<p:long,d:long>>").withColumns({"phash": F.col("variants")[0]["p"], "dhash": F.col("variants")[0]["d"]})
    for block in (2048, 7):
        got = {(x["i"], x["j"]): (x["variant"], x["dp"], x["dd"]) for x in similar.hamming_candidates(df, 12, block).collect()}
        want = {}
        for i, vi in rows:
            for j, vj in rows[i + 1 :]:
                d = [((v["p"] ^ vj[0]["p"]).bit_count(), (v["d"] ^ vj[0]["d"]).bit_count()) for v in vi]
                if any(max(x) <= 12 for x in d):
                    k = min(range(8), key=lambda k: (max(d[k]), sum(d[k]), k))
                    want[i, j] = (k, *d[k])
        assert got == want


def test_scenes(spark):
    taken = [0, 60, 121, None, 599, 601, 660, 5000] + [7000 + i for i in range(10)]
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(taken)], "idx long, taken long, phash long, dhash long")
    got = {(x["i"], x["j"]) for x in similar.scene_candidates(df).collect()}
    assert got == {(0, 1), (4, 5), (5, 6)} | {(8 + i, 8 + j) for i in range(10) for j in range(i + 1, min(10, i + 7))}


def test_thresholds():
    assert [similar.parse_threshold(x) for x in ("strict", "normal", "loose", "0", "16")] == [4, 8, 12, 0, 16]
    assert [similar.candidate_bound(x) for x in (0, 12, 14, 16)] == [12, 12, 14, 16]
    for bad in ("17", "-1", "wide"):
        try:
            similar.parse_threshold(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_plan_guards_and_dry_run(spark):
    df = keep.recommend(members(spark, ("g", "/r/a", 1), ("g", "/r/b", 2), ("g", "/r/c", 3), ("h", "/r/d", 1), ("h", "/r/e", 1)), (), "/r")
    pick = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    reasons = {x["reason"] for x in actions.refusals(df, pick("/r/d", "/r/e", "/r/zz", "/r/b"), ("/r/b",)).collect()}
    assert reasons == {
        "/r/zz: not part of any duplicate group", "/r/b: is in a protected folder",
        "every copy of d (hhhhhhhhhhhh) is selected; at least one copy must be kept",
    }
    assert actions.refusals(df, pick("/r/b")).count() == 0
    planned = actions.plan(df, pick("/r/b", "/r/c", "/r/e"))
    assert {x["path"]: x["link_target"] for x in planned.collect()} == {"/r/b": "/r/a", "/r/c": "/r/a", "/r/e": "/r/d"}
    now = df.where("path not in ('/r/c', '/r/d')")
    results = actions.dry_run(planned, df, now)
    assert {x["path"]: x["status"] for x in results.collect()} == {"/r/b": "would act", "/r/c": "changed since scan", "/r/e": "kept copy missing or changed"}
    text = report.summary_text(actions.summary(results), actions.examples(results))
    assert "1 files would be moved to Trash, freeing 10 B." in text and "/r/c: no longer exists" in text
    assert {x["path"] for x in actions.groups_after(df, pick("/r/a", "/r/d")).collect()} == {"/r/b", "/r/c"}


def test_a_dry_run_is_logged_record_by_record(spark, tmp_path):
    shape = "group_id string, path string, size long, mtime_ns long, inode long, device long, hash string, verdict string"
    df = spark.createDataFrame([("g", f"/r/{x}", 5, 1, i, 1, "h", "keep" if x == "a" else "delete") for i, x in enumerate("abc")], shape)
    planned, folder = actions.plan(df, df.where("verdict = 'delete'")), str(tmp_path / "log")
    now = df.withColumn("mtime_ns", F.when(F.col("path") == "/r/c", 2).otherwise(F.col("mtime_ns")).cast("long"))
    for mode in (actions.TRASH, actions.HARDLINK):  # the second adds to the first
        assert actions.logged_dry_run(planned, df, now, folder, mode).count() == 2
    lines = [json.loads(x["value"]) for x in spark.read.text(folder).collect()]
    assert {x["action"] for x in lines} == {"trash", "hardlink"} and len(lines) == 4
    by = {(x["action"], x["path"]): x for x in lines}
    plain = by["trash", "/r/b"]
    assert plain.pop("ts").endswith("+00:00")
    assert plain == {"action": "trash", "kind": "file", "path": "/r/b", "size": 5, "hash": "h", "status": "would act"}
    assert by["hardlink", "/r/b"]["linked_to"] == "/r/a" and "identity" in by["trash", "/r/c"]["detail"]
    assert report.read_log(spark, folder).where("linked_to is null").count() == 2
    # folders of a hidden plan say what they are, and have no hash
    hidden_plan = planned.drop("hash").withColumn("is_dir", F.lit(True))
    assert {(x["kind"], x["hash"]) for x in actions.log_records(hidden_plan, actions.dry_run(planned, df, now)).collect()} == {("folder", None)}


def test_snapshot(spark, tmp_path):
    row = ("/a", 1, 2, 3, 4, "p", None, "x", "v1")
    old = spark.createDataFrame([row, ("/b", 1, 2, 3, 4, "p", "f", None, None)], snapshot.SCHEMA)
    new = spark.createDataFrame([("/a", 1, 2, 3, 4, None, "f2", None, None), ("/b", 9, 2, 3, 4, "q", None, None, None)], snapshot.SCHEMA)
    got = {x["path"]: (x["size"], x["partial"], x["full"], x["perceptual"]) for x in snapshot.upsert(old, new).collect()}
    assert got == {"/a": (1, "p", "f2", "x"), "/b": (9, "q", None, None)}
    snapshot.save(old, str(tmp_path / "s"))
    kept, warning = snapshot.load(spark, str(tmp_path / "s"))
    assert warning is None and kept.count() == 2
    none, warning = snapshot.load(spark, str(tmp_path / "gone"))
    assert none.count() == 0 and warning
    files_now = spark.createDataFrame([("/a", 1, 2, 3, 4), ("/b", 1, 7, 3, 4)], "path string, size long, mtime_ns long, inode long, device long")
    hit = {x["path"]: (x["partial"], x["perceptual"]) for x in snapshot.hits(files_now, kept, "v1").collect()}
    assert hit == {"/a": ("p", "x"), "/b": (None, None)}
    assert snapshot.hits(files_now, kept, "v2").where("perceptual is not null").count() == 0


def test_groups_are_written_member_by_member(spark):
    n = 60_000
    one = spark.range(n).select(
        F.lit("g1").alias("group_id"), F.lit("h").alias("hash"), F.lit(7).cast("long").alias("size"), F.format_string("/r/%07d", "id").alias("path"),
        F.col("id").alias("mtime_ns"), F.when(F.col("id") % 1000 == 5, F.array(F.format_string('/l"/%d', "id"))).otherwise(F.array().cast("array<string>")).alias("links"),
    )
    few = spark.createDataFrame([("g0", "k", 3, f"/q/{x}", 1, []) for x in "ab"], one.schema)
    members = few.unionByName(one)
    found, longest = [], []

    def write(text):
        found.append(text), longest.append(len(text))

    report.write_document(write, {"root": "/r"}, {"groups": report.exact_groups(members), "none": report.exact_groups(members.limit(0))})
    document = json.loads("".join(found))
    rows = [json.loads(x["json"]) for x in report.exact_json(members).orderBy("group_id").collect()]
    assert document["groups"] == rows and document["none"] == [] and len(rows[1]["files"]) == n and len(rows[1]["hardlinked"]) == 60
    assert max(longest) < 200


def _pair_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        p, d = rng.getrandbits(63), rng.getrandbits(63)
        flip = sum(1 << b for b in rng.sample(range(62), rng.randrange(0, 16)))
        turned = [(p ^ m * 1234567890123, d ^ m * 1234567890123) for m in range(8)]
        near = turned[rng.randrange(8)]
        rows += [(k, turned, p, d), (k + n // 2, [(x ^ flip, y ^ flip) for x, y in turned], near[0] ^ flip, near[1] ^ flip)]
    return rows


@pytest.mark.parametrize("bound", [0, 1, 5, 12, 16])
@pytest.mark.parametrize("size", [30_000, 500_000])
def test_indexed_pairs_equal_all_compared(bound, size):
    import numpy as np

    plan = similar._segments(bound, size)
    assert plan and sum(t + 1 for _, _, t in plan) == bound + 1
    p = np.array([x[2] for x in _pair_rows(800, bound)], np.uint64)
    want = {(q, c) for a in similar._plain(p[::3], p, bound) for q, c in zip(*map(np.ndarray.tolist, a))}
    got = {(q, c) for a in similar._indexed(p[::3], p, bound, plan) for q, c in zip(*map(np.ndarray.tolist, a))}
    assert len(want) >= len(p[::3]) and got == want


def test_a_look_up_costs_a_fraction_of_its_block():
    for bound in (12, 16):
        cost = sum(len(similar._ball(w, t)) * (similar.LOOK_UP + similar.FOUND * similar._slots(similar.BLOCK, w)) for _, w, t in similar._segments(bound, similar.BLOCK))
        assert cost < similar.PLAIN * similar.BLOCK * {12: 0.1, 16: 0.7}[bound]


def test_images_that_share_an_index_give_a_pair_once(spark):
    rows = [(i, [(p ^ m * 99991, p ^ m * 99991) for m in range(8)], p, p) for i, p in [(1, 0xF0F0F0F0), (2, 0xF0F0F0F1), (2, 0xF0F0F0F3)]]
    df = spark.createDataFrame(rows, "idx long, variants array<struct<p:long,d:long>>, phash long, dhash long")
    found = similar.hamming_candidates(df, 12)
    assert [(x["i"], x["j"], x["variant"], x["dp"], x["dd"]) for x in found.collect()] == [(1, 2, 0, 1, 1)]
