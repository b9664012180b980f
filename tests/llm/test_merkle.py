"""Merkle manifests against a plain tree, and proofs that must not hold."""

import hashlib
import random
import zlib

import pytest

from twinsift.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, n long, g string, node long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, siblings of each node from below to above, as (side, digest))."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            beside = at ^ 1
            paths[k].append((at & 1, nodes[beside] if beside < len(nodes) else None))
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], paths


def fold(node, path):
    for side, beside in path:
        node = h(node if beside is None else beside + node if side else node + beside)
    return node


def brute(rows):
    langs = sorted({x[2] for x in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by, subroots = {}, []
    for lang in langs:
        own = sorted(((x, leaf(*x)) for x in rows if x[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        root, paths = tree([x[1] for x in own])
        by[lang] = own, paths
        subroots.append(root)
    top, above = tree(subroots)
    out = []
    for lang, subroot, up in zip(langs, subroots, above):
        for (row, own), path in zip(*by[lang]):
            whole = path + up
            changed = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                changed = leaf(*row[:4], row[4] + 1)
            folded = fold(changed, whole)
            assert fold(own, whole) == top
            out.append((row[0], own, subroot, top, h("".join(b for _, b in whole if b)), folded, folded == top))
    return sorted(map(str, out))


def found(spark, rows, levels=merkle.LEVELS):
    df = spark.createDataFrame([(*x, "p", 3, "g", 4) for x in rows], SCHEMA).repartition(3)
    return sorted(str(tuple(x)) for x in merkle.manifest(df, levels).collect())


@pytest.mark.parametrize("n, levels", [(1, 12), (2, 12), (37, 2), (300, 3), (300, 12), (65, 1)])
def test_equals_plain_tree(n, levels, spark):
    random.seed(n)
    rows = [(i, "x" * random.randint(0, 9), random.choice(["de", "en", "é", "z" * 3]), "s", i % 5) for i in random.sample(range(10 * n), n)]
    assert found(spark, rows, levels) == brute(rows)


def test_many_languages(spark):
    rows = [(i, "t", f"lang {i % 40}", None, i) for i in range(90)]
    assert found(spark, rows, 2) == brute(rows)


def test_edges(spark):
    rows = [
        (1, None, None, None, None), (0, "", None, "", 0), (7, "é😀", "", "a", 2), (7, "é😀", "", "a", 2), (7, "other", "", "a", 5),
        (None, "a", "en", "b", 1), (None, "b", "en", "b", 1), (None, None, None, None, None), (-3, "x" * 300_000, "en", "b", 300_000),
    ]
    assert found(spark, rows, 1) == brute(rows)
    assert found(spark, rows) == brute(rows)


def test_equal_rows_without_end(spark):
    rows = [(5, "same", "en", "s", 4)] * 70
    assert found(spark, rows, 3) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_tampering_shows(spark):
    rows = [(i, "t", "en", "s", None if i % 3 else 1) for i in range(60)]
    hit = {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 3 == 0}
    df = spark.createDataFrame([(*x, "p", 3, "g", 4) for x in rows], SCHEMA)
    assert {x.doc_id for x in merkle.manifest(df).where("not verified").collect()} == hit and hit
