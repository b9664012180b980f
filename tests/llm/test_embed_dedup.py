"""Product quantisation against brute force over all pairs."""

import numpy as np
import pandas as pd

from twinsift.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n long"


def brute(rows, least=0.9):
    """(id, n_links, component, kept) of (id, vector) rows, sorted as text."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v) in enumerate(rows) if sound(v)]
    units = {i: np.asarray(rows[i][1], float) / np.linalg.norm(np.asarray(rows[i][1], float)) for i in good}
    near = {i: [j for j in good if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in good}
    out, root = [], {}
    for i in range(len(rows)):
        if i in root:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root |= dict.fromkeys(seen, min(ids, default=None))
    for i, (own, _) in enumerate(rows):
        out.append((own, len(near.get(i, [])), root[i], own == root[i]))
    return sorted(map(str, out))


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], SCHEMA).repartition(3)
    return sorted(str(tuple(r)) for r in embed_dedup.near_duplicates(df, **more).collect())


def planted(n, seed, wide=16):
    """Random vectors, near copies at several cosines, a chain and a crowd around one direction."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, wide))
    rows = [v / np.linalg.norm(v) * rng.uniform(0.1, 9) for v in base]
    for k in range(n // 2):
        noise = rng.normal(size=wide)
        noise -= noise @ base[k] / (base[k] @ base[k]) * base[k]
        cosine = [0.86, 0.905, 0.93, 0.99][k % 4]
        unit, away = base[k] / np.linalg.norm(base[k]), noise / np.linalg.norm(noise)
        rows.append(cosine * unit + np.sqrt(1 - cosine**2) * away)
    angles = np.arange(12) * 0.3
    rows += [np.pad([np.cos(a), np.sin(a)], (0, wide - 2)) for a in angles]
    rows += [base[0] + rng.normal(size=wide) * 0.02 for _ in range(n)]
    return [(i, np.asarray(v, np.float32).tolist()) for i, v in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = planted(120, 3)
    assert found(spark, rows, probes=embed_dedup.CELLS) == brute(rows)


def test_crowded_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "CHUNK", 7)
    rows = planted(90, 5)
    assert found(spark, rows, probes=embed_dedup.CELLS) == brute(rows)


def test_links_are_sound_and_recall_is_high_with_few_probes(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.normal(size=(1500, 64))
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    both = np.concatenate([base, 0.901 * base + np.sqrt(1 - 0.901**2) * away])
    rows = [(i, v.tolist()) for i, v in enumerate(both)]
    df = spark.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], SCHEMA)
    got = embed_dedup.near_duplicates(df).toPandas().set_index("vec_id")["n_links"]
    units = np.asarray([np.float32(v) for _, v in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    real = pd.Series((units @ units.T >= 0.9).sum(1) - 1)
    assert (got.sort_index().to_numpy() <= real.to_numpy()).all()
    assert got.sum() >= 0.95 * real.sum()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
        (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.01]), (None, [5.0, 0.0]), (None, [0.0, 1.0]), (None, None), (10, [-0.0, -1.0]),
        (11, [0.0, -1.0]), (12, [1e-38, 0.0]), (13, [3e38, 3e38]), (14, [-1.0, 0.0]),
    ]
    rows += [(20 + k, [0.5, 0.5]) for k in range(30)]
    assert found(spark, rows) == brute(rows)


def test_without_rows_or_sound_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == ["(1, 0, 1, True)"]


def test_one_vector(spark):
    assert found(spark, [(3, [1.0, 2.0])]) == ["(3, 0, 3, True)"]


def test_codes_leave_out_what_they_say(spark):
    rows = np.random.default_rng(2).normal(size=(400, 20))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = embed_dedup.fit(rows, 400, 2)
    cells = index.nearest(rows, 1)[:, 0]
    codes, left = index.encode(rows, cells)
    built = index.centroids[cells] + np.concatenate([b[c] for b, c in zip(index.codebooks, codes.T)], 1)[:, :20]
    assert np.allclose(np.linalg.norm(rows - built, axis=1), left)
    assert (np.abs(rows @ rows.T - rows @ built.T) <= left + 1e-12).all()
