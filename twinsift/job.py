"""A handle on a running scan: what its stages have seen, and a way to stop it from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators.base import checkpointed

Result = TypeVar("Result")


class Cancelled(Exception):
    """The scan was stopped from outside."""


@dataclass(frozen=True)
class Progress:
    """A stage's rows and their bytes, all of them once it has ended."""

    stage: str
    rows: int
    size: int


class Job:
    """Counts ride along with the stages as observed metrics; no job runs for them alone.

    ``watch`` is called on the scan's thread after each stage.  ``cancel`` may be called from any thread: it stops the Spark jobs
    that carry this handle's tag, and no others, and keeps further stages from starting.  It is a tag of jobs: a session's
    tags don't reach those that write checkpoints.
    """

    def __init__(self, spark: SparkSession, watch: Callable[[Progress], None] | None = None):
        self.spark, self.watch, self.tag = spark, watch, f"twinsift-{uuid.uuid4().hex}"
        self.cancelled, self.seen, self.ended = False, {}, threading.Event()

    def cancel(self) -> None:
        """Stop what runs now; until the scan has ended, also what it was just about to start."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        threading.Thread(target=self._chase, daemon=True).start()

    def _chase(self) -> None:
        while not self.ended.wait(0.2):
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Write rows (with ``size``) to the checkpoint folder and say how many they are."""
        self.check()
        observed = Observation(f"{name}-{uuid.uuid4().hex}")
        size = F.coalesce(F.sum("size" if "size" in rows.columns else F.lit(0)), F.lit(0)).cast("long")
        written = checkpointed(rows.observe(observed, F.count(F.lit(1)).alias("rows"), size.alias("size")))
        found = observed.get
        self.seen[name] = Progress(name, found["rows"], found["size"])
        if self.watch is not None:
            self.watch(self.seen[name])
        self.check()
        return written

    def run(self, work: Callable[[], Result], stopped: Callable[[], Result]) -> Result:
        """What ``work`` gives, or ``stopped`` if the job was cancelled on the way."""
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            self.check()
            return work()
        except Cancelled:
            return stopped()
        except (PySparkException, Py4JError):
            if not self.cancelled:
                raise
            return stopped()
        finally:
            self.ended.set()
            self.spark.sparkContext.removeJobTag(self.tag)
