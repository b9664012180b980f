"""Panes with revisions against a plain loop over batches."""

import datetime
import math
import random
import zlib

from twinsift.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, batch string, hour int, w int"
EPOCH = datetime.datetime(1970, 1, 1)


def micros(time):
    return (time - EPOCH) // datetime.timedelta(microseconds=1)


def brute(rows, n_batches):
    first = {}
    for click_id, ts, arrived, _, kind, value in rows:
        if ts is not None:
            key = (arrived is None, arrived or EPOCH, ts, (kind is not None, kind or ""), (value is not None, value or 0))
            if click_id not in first or key < first[click_id][0]:
                first[click_id] = key, (ts, arrived, kind, value)
    batches = [[] for _ in range(n_batches)]
    for click_id, (_, (ts, arrived, kind, value)) in first.items():
        day = ((arrived or ts) - EPOCH).days
        turn = day % n_batches
        more = 0 if click_id is None else max(0, zlib.crc32(str(click_id).encode()) % 30 - 23)
        event = micros(ts) - (day - turn) * panes.DAY
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        batches[min(n_batches - 1, turn + more)].append((click_id, event, event // panes.HOUR, "none" if kind is None else kind, cents))
    state, w, out = {}, None, []
    for b, batch in enumerate(batches):
        fresh = {}
        for click_id, _, hour, kind, cents in batch:
            if w is not None and w >= (hour + 1) * panes.HOUR + panes.CLOSED:
                out.append((b, hour, click_id, 1, cents, "late", kind))
            else:
                n, c = fresh.get((kind, hour), (0, 0))
                fresh[kind, hour] = n + 1, c + cents
        for pane in sorted(state.keys() | fresh.keys()):
            kind, hour = pane
            n, c, emitted = state.get(pane, (0, 0, False))
            more, rise = fresh.get(pane, (0, 0))
            due = w is not None and w >= (hour + 1) * panes.HOUR + panes.DUE
            if emitted and more:
                out += [(b, hour, -1, n, c, "retract", kind), (b, hour, -1, n + more, c + rise, "replace", kind)]
            if not emitted and due:
                out.append((b, hour, -1, n + more, c + rise, "emit", kind))
            elif not emitted and b == n_batches - 1:
                out.append((b, hour, -1, n + more, c + rise, "final", kind))
            state[pane] = n + more, c + rise, emitted or due
            if w is not None and w >= (hour + 1) * panes.HOUR + panes.CLOSED:
                del state[pane]
        w = max([x for x in [w, *(e for _, e, *_ in batch)] if x is not None], default=None)
    return sorted(map(str, out))


def found(spark, rows, n_batches, n_shards=3):
    df = spark.createDataFrame([(*x, "batch", 1, 2) for x in rows], SCHEMA).repartition(3)
    return sorted(str(tuple(x)) for x in panes.revisions(df, n_batches, n_shards).collect())


def test_equals_a_plain_loop(spark):
    random.seed(4)
    rows = []
    for i in range(3000):
        arrived = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=random.random() ** 2 * 40 * 86400)
        late = random.choice([1, 60, 3600, 20_000, 500_000]) * random.random()
        rows.append((i, arrived - datetime.timedelta(seconds=late), arrived, 1, random.choice(["a", "a", "a", "b"]), random.uniform(-50, 900)))
    rows += random.sample(rows, 200)
    got = found(spark, rows, 5)
    assert got == brute(rows, 5)
    assert {"emit", "retract", "replace", "late", "final"} <= {x.split("'")[1] for x in got}


def test_edges(spark):
    at = datetime.datetime(2024, 2, 1, 10, 30, 5, 999_999)
    day = datetime.timedelta(days=1)
    rows = [
        (1, at, at, 1, None, None), (1, at, at, 1, None, None), (2, None, at, 1, "a", 1.0), (3, at, None, None, "a", float("nan")),
        (None, at, at, 1, "a", 2.5), (None, at - day, at - day, 1, "a", 3.5), (4, at - 90 * day, at, 1, "", 0.005),
        (5, at, at + day, 1, "a", float("inf")), (6, at + day, at + 2 * day, 1, "none", 1e6), (7, at, at + 2 * day, 1, "é", -0.005),
        (2, at, at, 1, "a", 7.0), (8, EPOCH - 5 * day, EPOCH - 4 * day, 1, "x" * 10_000, 1.0), (9, at, at, 1, "a", 1.0), (9, at, at - day, 1, "b", 2.0),
    ]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_empty_table(spark):
    assert found(spark, [], 2) == []


def test_every_call_has_its_own_folder(spark):
    at = datetime.datetime(2024, 2, 1)
    rows = [(i, at, at, 1, "a", 1.0) for i in range(4)]
    assert found(spark, rows, 2) == found(spark, rows, 2) == brute(rows, 2)


def test_hot_pane_is_few_rows_before_the_shuffle():
    import pandas as pd

    n = 5000
    rows = pd.DataFrame({
        "shard": 1, "batch": 0, "late": [False] * (n - 1) + [True], "kind": "a", "hour": 7, "click_id": range(n), "n_rows": 1, "cents": 2,
        "w": pd.array([None] * n, "Int64"), "last": pd.array([None] * n, "boolean"),
    })
    parts = pd.concat(panes.summed(iter([rows[: n // 2], rows[n // 2 :]])))
    assert len(parts) == 2 and parts.loc[~parts["late"], ["n_rows", "cents"]].values.tolist() == [[n - 1, 2 * (n - 1)]]


def test_state_takes_no_native_memory(spark):
    at = datetime.datetime(2024, 2, 1)
    rows = [(i, at, at, 1, "a", 1.0) for i in range(4)]
    assert found(spark, rows, 2) == brute(rows, 2)
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/maps") as maps:
        assert "rocksdb" not in maps.read()
