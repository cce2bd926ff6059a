"""Bounds of Arrow batches, and names for columns added to a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollkeep.sources.scratch import materialize

__all__ = ["fresh", "lean_batches", "materialize"]

#: Rows and bytes of an Arrow batch: whole texts can be long, and a worker holds a few copies of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold no more than the bounds above."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
