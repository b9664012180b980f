"""Counts and sums by kind and hour that are emitted, revised and closed as event time moves on.

Rows are cut into batches, written to a folder and fed in order to a stateful streaming query, which is started
anew for each batch on one checkpoint.  Every batch, even an empty one, holds a control row for each
state shard: the watermark W, the greatest event time of all earlier batches, and whether it is the last.  A
shard first adds the batch's rows to its panes (the state of its group), then the control row settles
them: due panes are emitted, emitted ones with new rows are retracted and replaced, closed ones are
forgotten, and at the end what was never emitted is final.

Before rows are dealt to shards each task sums up its rows of a pane, so that a hot pane is a few rows
of each task; rows of closed panes, which need no state, go through whatever shard their id
names.  The driver keeps one watermark for each batch.  Output is a file sink's, so that a batch that
runs again after a failure counts once.

Rows with a null time are dropped.  Of rows with one ``click_id`` the first by arrival (null last), then time counts; null ids are one
id, in no later batch than their day says.  A null arrival is at the row's own time.  A null kind is ``none``; a null value,
or one that isn't finite, counts as 0 cents.  An empty table gives an empty result; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import checkpoint_folder

BATCHES, SHARDS = 12, 16
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: A pane is due so long after its end, and closed so long after it, in microseconds.
DUE, CLOSED = 2 * HOUR, 3 * DAY
#: Panes that a task sums up before it sends them on.
MOST_PANES = 50_000
ROWS = "kind string, hour long, click_id long, cents long, event long, shard int, w long, last boolean"
PARTS = "shard int, batch long, late boolean, kind string, hour long, click_id long, n_rows long, cents long, w long, last boolean"
#: A shard's open panes, column by column.
STATE = "kind array<string>, hour array<long>, n_rows array<long>, cents array<long>, emitted array<boolean>"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"


def _micros(time: Column) -> Column:
    """Microseconds since 1970 as the clock shows them, with or without a zone."""
    second = F.extract(F.lit("SECOND"), time) * 1_000_000
    return F.unix_date(time.cast("date")).cast("long") * DAY + F.hour(time).cast("long") * HOUR + F.minute(time).cast("long") * 60_000_000 + second.cast("long")


def batched(clicks: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """(kind, hour, click_id, cents, event, batch), each click once; ``event`` in microseconds."""
    first = F.struct(F.col("arrived_at").isNull().alias("none"), "arrived_at", "ts", "kind", "value")
    once = clicks.where("ts is not null").groupBy("click_id").agg(F.min(first).alias("c")).select("click_id", "c.*")
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date"))
    turn = F.pmod(day, F.lit(n_batches))
    more = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23, F.lit(0))
    value = F.when(F.abs("value") < float("inf"), F.col("value"))
    event = _micros(F.col("ts")) - (day - turn).cast("long") * DAY
    return once.select(
        F.coalesce("kind", F.lit("none")).alias("kind"), "click_id", F.coalesce(F.floor(100 * value + 0.5), F.lit(0)).alias("cents"),
        event.alias("event"), F.least(F.lit(n_batches - 1), turn + F.greatest(F.lit(0), more)).cast("int").alias("batch"),
    ).withColumn("hour", (F.col("event") - F.pmod("event", F.lit(HOUR))) / HOUR).withColumn("hour", F.col("hour").cast("long"))


def is_closed(hour: Column, w: int | None) -> Column:
    return F.lit(False) if w is None else (hour + 1) * HOUR + CLOSED <= w


def _shard(n_shards: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(n_shards)).cast("int")


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each pane of this task, late rows and control rows as they are."""
    held: dict[tuple, list[int]] = {}
    names = [x.split()[0] for x in PARTS.split(", ")]

    def out() -> pd.DataFrame:
        rows = [(shard, batch, False, kind, hour, None, n, cents, None, None) for (shard, batch, kind, hour), (n, cents) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=names).astype({"click_id": "Int64", "w": "Int64", "last": "boolean"})

    for rows in batches:
        into = rows["last"].isna() & ~rows["late"]
        sums = rows[into].groupby(["shard", "batch", "kind", "hour"])["cents"].agg(["size", "sum"])
        for key, n, cents in zip(sums.index, sums["size"].tolist(), sums["sum"].tolist()):
            old = held.setdefault(key, [0, 0])
            old[0] += n
            old[1] += cents
        if not into.all():
            yield rows.loc[~into, names]
        if len(held) > MOST_PANES:
            yield out()
    if held:
        yield out()


def settled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a batch makes known of a shard, whose open panes are the state."""
    fresh: dict[tuple, list[int]] = {}
    control = None
    for part in parts:
        late = part[part["late"]]
        if len(late):
            yield _records(late["batch"], late["hour"], late["click_id"], late["n_rows"], late["cents"], "late", late["kind"])
        for x in part[part["last"].notna()].itertuples():
            control = int(x.batch), None if pd.isna(x.w) else int(x.w), bool(x.last)
        data = part[~part["late"] & part["last"].isna()]
        for kind, hour, n, cents in zip(data["kind"], data["hour"].tolist(), data["n_rows"].tolist(), data["cents"].tolist()):
            sums = fresh.setdefault((kind, int(hour)), [0, 0])
            sums[0] += int(n)
            sums[1] += int(cents)
    if control is None:
        raise ValueError("a batch came without its control row")
    held = {(k, h): (n, c, e) for k, h, n, c, e in zip(*state.get)} if state.exists else {}
    found = _settle(held, fresh, *control[1:])
    state.update(tuple(map(list, zip(*((*k, *v) for k, v in held.items())))) if held else ([], [], [], [], []))
    if found:
        yield _records(control[0], *zip(*found))


def _settle(held: dict, fresh: dict, w: int | None, last: bool) -> list[tuple]:
    """(hour, click_id, n_rows, cents, record, kind) of what the batch makes known; ``held`` becomes the panes after it."""
    found = []
    for pane in held.keys() | fresh.keys():
        kind, hour = pane
        n, cents, emitted = held.get(pane, (0, 0, False))
        more, rise = fresh.get(pane, (0, 0))
        due = w is not None and w >= (hour + 1) * HOUR + DUE
        if emitted and more:
            found += [(hour, -1, n, cents, "retract", kind), (hour, -1, n + more, cents + rise, "replace", kind)]
        elif not emitted and (due or last):
            found.append((hour, -1, n + more, cents + rise, "emit" if due else "final", kind))
        if w is not None and w >= (hour + 1) * HOUR + CLOSED:
            held.pop(pane, None)
        else:
            held[pane] = n + more, cents + rise, emitted or due
    return found


def _records(batch, hour, click_id, n_rows, cents, record, kind) -> pd.DataFrame:
    found = {"batch": batch, "hour": hour, "click_id": click_id, "n_rows": n_rows, "cents": cents, "record": record, "kind": kind}
    return pd.DataFrame(found if isinstance(hour, pd.Series) else {k: list(v) if isinstance(v, tuple) else v for k, v in found.items()}).reset_index(drop=True)


#: State is kept in the executors' heaps: a store of RocksDB takes native memory for each of its shards, starts and executors,
#: which no heap bounds.  Stores of earlier starts are closed soon.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.session.timeZone": "UTC",
}


def _streaming(spark: SparkSession, n_shards: int) -> SparkSession:
    """A session of its own, whose settings for the state store change nobody else's."""
    session = spark.newSession()
    for name, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(n_shards)}.items():
        session.conf.set(name, value)
    return session


def revisions(clicks: DataFrame, n_batches: int = BATCHES, n_shards: int = SHARDS) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): all that the batches write, read from a new folder."""
    spark = clicks.sparkSession
    folder = f"{checkpoint_folder(spark)}/panes-{uuid.uuid4().hex}"
    feed = f"{folder}/feed"
    batched(clicks, n_batches).write.partitionBy("batch").parquet(feed)
    greatest = dict(spark.read.schema("event long, batch int").parquet(feed).groupBy("batch").agg(F.max("event")).collect())
    marks: list[int | None] = [None]  # a watermark for each batch
    for k in range(n_batches - 1):
        marks.append(max((x for x in (marks[-1], greatest.get(k)) if x is not None), default=None))
    control = spark.createDataFrame(
        [(s, marks[k], k == n_batches - 1, k) for k in range(n_batches) for s in range(n_shards)], "shard int, w long, last boolean, batch int"
    )
    control.coalesce(1).write.mode("append").partitionBy("batch").parquet(feed)
    session = _streaming(spark, n_shards)
    for k, w in enumerate(marks):
        late = F.coalesce(F.col("last").isNull() & is_closed(F.col("hour"), w), F.lit(False))
        # what an earlier start has read is in the checkpoint, so that this one finds its own batch new
        visible = ",".join(map(str, range(k + 1)))
        rows = session.readStream.schema(ROWS).parquet(f"{feed}/batch={{{visible}}}")
        rows = rows.withColumns({"batch": F.lit(k).cast("long"), "late": late, "n_rows": F.lit(1).cast("long")})
        dealt = F.when(F.col("last").isNotNull(), F.col("shard")).when(late, _shard(n_shards, "click_id")).otherwise(_shard(n_shards, "kind", "hour"))
        parts = rows.withColumn("shard", dealt).select(*[x.split()[0] for x in PARTS.split(", ")]).mapInPandas(summed, PARTS)
        found = parts.groupBy("shard").applyInPandasWithState(settled, RECORDS, STATE, "append", GroupStateTimeout.NoTimeout)
        written = found.writeStream.format("parquet").options(path=f"{folder}/out", checkpointLocation=f"{folder}/state")
        written.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RECORDS).parquet(f"{folder}/out")
