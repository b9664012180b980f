"""What the operators of this subpackage share: checkpoints and bounded Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ``[^\x20\x09-\x0D]+`` for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is unset, a local master (tests) gets a temporary folder; a cluster gets none,
    as its executors couldn't read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="twinsift-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; the rows are written to the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def blocks(
    batches: Iterator[pa.RecordBatch], text: int = 1, most_bytes: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts hold ``most_bytes`` at most, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)
