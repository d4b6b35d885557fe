"""Small helpers that the training-data operators have in common."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.plans.storage import new_path, shared_dir, stored

__all__ = ["Memo", "Scratch", "few", "kept_by", "lean", "new_path", "partitions", "shared_dir", "stored"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 500_000  # of one or two numbers


def few(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``rows`` of one or two numbers, to be broadcast if they are counted to be no more than ``BROADCAST_ROWS``; counted is ``of``, if given, a stored table that has as many at least."""
    return F.broadcast(rows) if (rows if of is None else of).count() <= BROADCAST_ROWS else rows


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Stored tables of one run, in the shared folder, that the run can drop when it has ended."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def stored(self, df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
        """Store a table; ``arrow_rows`` bounds the rows, if they are wide, that a Python worker gets at once."""
        before = self.spark.conf.get(ARROW_ROWS, None)
        if arrow_rows:
            self.spark.conf.set(ARROW_ROWS, str(arrow_rows))
        try:
            out = stored(df, f"{self.name}-{name}")
        finally:
            if arrow_rows and before is None:
                self.spark.conf.unset(ARROW_ROWS)
            elif arrow_rows:
                self.spark.conf.set(ARROW_ROWS, before)
        self.paths[id(out)] = (out, os.path.dirname(out.inputFiles()[0]) if out.inputFiles() else None)
        return out

    def drop_but(self, *kept: DataFrame) -> None:
        """Delete all tables but those that are still to be read."""
        jvm = self.spark._jvm
        for key, (_, path) in list(self.paths.items()):
            if path and key not in {id(x) for x in kept}:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                del self.paths[key]


_kept: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """What the tasks of one operator keep in this process.

    A Python worker serves one operator after another and would hold what all of them keep,
    so tasks call this first, and what others have kept goes.
    """
    others = [x for name, x in _kept.items() if name != owner and x]
    for x in others:
        x.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    return _kept.setdefault(owner, {})


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow's pool holds of one that is done goes back to the system, else a worker keeps some hundred MB."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """A bounded memo: it is emptied when full, which changes cost and never results."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 256:
            self[key] = value
        return value
